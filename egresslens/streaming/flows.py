"""Structured Streaming forms of the operators."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from egresslens.operators import detect, filters, match, models, objects, reassembly, totals
from egresslens.operators.ordered import running
from egresslens.schemas import PACKETS, conform, layer
from egresslens.session import materialize, work_path


def stream_findings(packets: DataFrame, host: str) -> DataFrame:
    """Stateless findings as they arrive; saved files carry no running name number."""
    found = detect.findings(packets, *detect.stateless_detectors(host))
    saved = objects.extract_objects(packets).drop("payload").withColumn("filename", F.lit(None).cast("string"))
    return found.unionByName(objects.object_findings(saved))


def windowed_outbound(packets: DataFrame, host: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bytes per destination and time window; state of old windows is dropped by the watermark."""
    return (
        packets.withWatermark("ts", late)
        .select("ts", filters.source().alias("src"), filters.destination().alias("dst"), "length")
        .filter((F.col("src") == host) & F.col("dst").isNotNull())
        .groupBy(F.window("ts", every).alias("w"), "dst")
        .agg(F.sum("length").cast("bigint").alias("bytes"))
        .select(F.col("w.start").alias("start"), "dst", "bytes"))


def running_outbound(packets: DataFrame, host: str) -> DataFrame:
    """Bytes per destination since the start, for complete output."""
    return totals.outbound_by_destination(packets, host)


def stream_matches(carried: DataFrame, targets: DataFrame) -> DataFrame:
    """Carried files of a stream against a static target list."""
    hashes = match.target_hash_set(targets).select(F.col("hash").alias("sha256"))
    return carried.join(hashes, "sha256", "left_semi")


def stream_scores(features: DataFrame, model: PipelineModel, keep=("frame_no",)) -> DataFrame:
    return models.score(model, features, keep, "p")


_TRANSFER = ("capture_id string, src string, dst string, port int, opened bigint, filename string, complete boolean, "
             "blocks int, size bigint, frame_no bigint, payload binary")
_EVENT = ("capture_id string, frame_no bigint, src string, dst string, sport int, dport int, is_request boolean, "
          "filename string, block bigint, data binary, at bigint")
_MARK = "watermark bigint, since bigint"
#: Before all times, in milliseconds.
_NEVER = -(1 << 62)


class TransferStream:
    """TFTP transfers of a stream, through tables below ``path``; for ``foreachBatch``.

    Each batch appends its events under its number, together with the latest packet time so far. A pair's events
    form a session until it is silent for ``idle``. When the watermark, the latest time less ``late``, has passed
    the end of a session, the session goes through the batch form once and its transfers are written under the number
    of the batch that moved the watermark; an open transfer ends there as incomplete. Packets may come in any
    order within ``late``; later ones are left out, as are events behind the watermark of the batch before.

    There is no state but the tables. A batch that runs again overwrites its own tables with the same rows, since what it
    reads of others is fixed before it starts. Times are read without payloads; payloads are read once, when their session
    ends. Packets without a time count as on time.
    """

    def __init__(self, spark: SparkSession, path: str, idle: str = "60 minutes", late: str = "10 minutes") -> None:
        self.spark, self.path = spark, path
        self.idle, self.late = (self._millis(x) for x in (idle, late))

    def _millis(self, interval: str) -> int:
        since = F.unix_millis(F.expr(f"timestamp_millis(0) + INTERVAL {interval}"))
        return self.spark.range(1).select(since.alias("ms")).first()["ms"]

    def _read(self, table: str, schema: str, batches: str) -> DataFrame:
        """Rows of a table whose batch number meets a condition."""
        return self.spark.read.schema(schema + ", batch bigint").parquet(f"{self.path}/{table}").filter(batches)

    def _write(self, df: DataFrame, table: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={number}")

    def _mark(self, number: int) -> Row | None:
        """Watermark after a batch and the first batch whose events were not done then."""
        if number < 0:
            return None
        return self._read("marks", _MARK, f"batch <= {number}").orderBy(F.desc("batch")).first()

    def __call__(self, packets: DataFrame, number: int) -> None:
        before = self._mark(number - 1)
        passed = before["watermark"] if before else _NEVER
        packets.persist()
        latest = packets.agg(F.unix_millis(F.max("ts")).alias("at")).first()["at"]
        watermark = max(passed, _NEVER if latest is None else latest - self.late)
        events = reassembly.tftp_events(packets, keep=("ts",)).withColumn(
            "at", F.coalesce(F.unix_millis("ts"), F.lit(max(watermark, 0)))).drop("ts")
        self._write(events.filter(F.col("at") > passed), "events", number)
        packets.unpersist()
        since = before["since"] if before else 0
        sessions = self._sessions(f"batch BETWEEN {since} AND {number}")
        waiting = sessions.filter(F.col("ends") >= watermark).agg(F.min("batch").alias("b")).first()["b"]
        self._release(sessions.filter((F.col("ends") >= passed) & (F.col("ends") < watermark)), number)
        # The mark comes last: until it is there the batch has not happened.
        self._write(self.spark.createDataFrame([(watermark, number + 1 if waiting is None else waiting)], _MARK), "marks", number)

    def _sessions(self, batches: str) -> DataFrame:
        """Events without payload, with the start of their session and the time by which it ends."""
        order = ["at", "frame_no"]
        events = self._read("events", _EVENT, batches).select(*reassembly.PAIR, *order, "batch")
        timed = running(events, reassembly.PAIR, order, lasts={"before": F.col("at")}, inclusive=False, width=self.idle)
        fresh = F.col("before").isNull() | (F.col("at") - F.col("before") > self.idle)
        named = running(timed, reassembly.PAIR, order, lasts={"session": F.when(fresh, F.col("at"))}, width=self.idle)
        named = materialize(named.drop("before"), "stream-sessions")
        ends = named.groupBy(*reassembly.PAIR, "session").agg((F.max("at") + self.idle).alias("ends"))
        return named.join(ends, [*reassembly.PAIR, "session"])

    def _release(self, ended: DataFrame, number: int) -> None:
        """Transfers of the sessions that have ended, by the batch form; sessions of a pair are kept apart."""
        ended = materialize(ended, "stream-ended")
        key = [*reassembly.PAIR, "frame_no"]
        events = self._read("events", _EVENT, f"batch <= {number}").join(ended.select(*key, "batch", "session"), [*key, "batch"])
        apart = F.concat("capture_id", F.lit("\n"), F.col("session").cast("string"))
        events = materialize(events.withColumn("capture_id", apart).drop("session", "batch", "at"), "stream-events")
        capture = F.regexp_extract(F.col("capture_id"), r"(?s)^(.*)\n-?\d+$", 1)
        self._write(reassembly.transfers_of(events).withColumn("capture_id", F.nullif(capture, F.lit(""))).select(
            "capture_id", "src", "dst", "port", "opened", F.col("original_filename").alias("filename"), "complete",
            F.col("blocks").cast("int").alias("blocks"), "size", "frame_no", "payload"), "transfers", number)

    def transfers(self) -> DataFrame:
        """The transfers that have ended so far, with the batch that ended them."""
        return self._read("transfers", _TRANSFER, "true")


def run_transfers(packets: DataFrame, name: str, idle: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Process the packets that are there and return the transfers that have ended; see ``TransferStream``.

    What still waits when input ends comes out once a later packet moves the watermark, for instance ``end_of_input``.
    """
    path = work_path(packets.sparkSession, name)
    sink = TransferStream(packets.sparkSession, path, idle, late)
    query = (packets.writeStream.option("checkpointLocation", f"{path}/state")
             .foreachBatch(sink).trigger(availableNow=True).start())
    query.awaitTermination()
    return sink.transfers()


def end_of_input(packets: DataFrame, after: str) -> DataFrame:
    """One packet later than all of ``packets`` by ``after`` (an interval), to be sent behind them.

    It is a write request between blank addresses: it moves the watermark and brings no row itself.
    """
    last = packets.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts"))
    return conform(last.filter("ts is not null"), PACKETS, frame_no=F.lit(0),
                   ip=layer("ip", src=F.lit(""), dst=F.lit("")), tftp=layer("tftp", opcode=F.lit("2"), filename=F.lit("")))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, through a table in the shared folder, and return that table."""
    spark = stream.sparkSession
    path = work_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state")
             .foreachBatch(write).trigger(availableNow=True).start())
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/data")
