import random

from pyspark.sql import functions as F

from egresslens.operators import reassembly
from egresslens.plans.bridges import tftp_packets
from egresslens.schemas import PACKETS, conform, layer
from egresslens.streaming import flows
from egresslens.sources.readers import stream_packets

from .conftest import SF


def packets(spark, events):
    """Events are (frame, src, dst, sport, dport, filename or None, block, size)."""
    df = spark.createDataFrame(
        [(f, s, d, sp, dp, name, b, (bytes([f % 251]) * n).hex()) for f, s, d, sp, dp, name, b, n in events],
        "frame_no bigint, src string, dst string, sport int, dport int, name string, block string, hexed string")
    is_request = F.col("name").isNotNull()
    return conform(
        df, PACKETS, ts=F.timestamp_seconds("frame_no"), ip=layer("ip", src=F.col("src"), dst=F.col("dst")),
        udp=layer("udp", srcport=F.col("sport"), dstport=F.col("dport")),
        tftp=layer("tftp", opcode=F.when(is_request, "2").otherwise("3"), filename=F.col("name"),
                   block=F.col("block"), data=F.when(~is_request, F.col("hexed"))))


def brute_force(events):
    """The three rules applied one event after the other."""
    held, out = {}, []
    for f, s, d, sp, dp, name, b, n in sorted(events):
        if name is not None:
            held[(s, d, sp)] = [name, {}]
            continue
        if n == 0:
            continue
        key = next((k for k in ((s, d, dp), (s, d, sp)) if k in held), None)
        key = key or next((k for k in held if k[:2] == (s, d)), None)
        if key:
            held[key][1][int(b)] = bytes([f % 251]) * n
            if n < 512:
                name, blocks = held.pop(key)
                out.append((name, b"".join(blocks[i] for i in sorted(blocks))))
    out += [(f"incomplete_{name}", b"".join(blocks[i] for i in sorted(blocks))) for name, blocks in held.values() if blocks]
    return sorted(out)


def random_events(seed, n=150):
    rng = random.Random(seed)
    ports = [1, 2, 3, 4]
    out = []
    for f in range(1, n):
        src, dst = rng.choice(["a", "a", "b"]), "s"
        if rng.random() < 0.2:
            out.append((f, src, dst, rng.choice(ports), 69, f"f{f}", None, 0))
        else:
            out.append((f, src, dst, rng.choice(ports), rng.choice([*ports, 69, 69, 69]), None, str(rng.randint(1, 4)), rng.choice([0, 512, 512, 512, 100])))
    return out


def rebuilt(df, width=20):
    rows = reassembly.rebuild_transfers(df, width).collect()
    return sorted((r["original_filename"], bytes(r["payload"])) for r in rows)


def test_random_transfers_equal_sequential_rules(spark):
    for seed in (1, 2):
        events = random_events(seed)
        assert rebuilt(packets(spark, events)) == brute_force(events)


def test_blocks(spark):
    w = lambda f, port, name: (f, "a", "s", port, 69, name, None, 0)
    d = lambda f, port, b, n: (f, "a", "s", port, 69, None, str(b), n)
    events = [w(1, 5, "one"), d(2, 5, 1, 512), d(3, 5, 1, 512), d(4, 5, 2, 9), d(5, 5, 3, 7), w(6, 6, "open"), d(7, 6, 1, 512)]
    got = dict(rebuilt(packets(spark, events)))
    assert got == {"one": bytes([3]) * 512 + bytes([4]) * 9, "incomplete_open": bytes([7]) * 512}


def test_captures_with_equal_frame_numbers(spark):
    one = [(1, "a", "s", 5, 69, "one", None, 0), (2, "a", "s", 5, 69, None, "1", 9)]
    two = [(1, "b", "s", 5, 69, "two", None, 0), (2, "b", "s", 5, 69, None, "1", 4), (3, "a", "s", 5, 69, None, "2", 4)]
    df = packets(spark, one).withColumn("capture_id", F.lit("x")).unionByName(
        packets(spark, two).withColumn("capture_id", F.lit("y")))
    got = {(r["capture_id"], r["original_filename"]): bytes(r["payload"]) for r in reassembly.rebuild_transfers(df, 20).collect()}
    assert got == {("x", "one"): bytes([2]) * 9, ("y", "two"): bytes([2]) * 4}


def streamed(spark, parts, path, **options):
    """Transfers of a stream whose files are the given tables, in this order."""
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(path)
    stream = stream_packets(spark, path, "parquet", PACKETS, files_per_trigger=1, capture_per_file=False)
    return flows.run_transfers(stream, "t", **options).collect()


def test_stream_equals_batch_with_late_files_first(spark, tmp_path):
    df = tftp_packets(spark, SF)
    cut = df.agg(F.percentile_approx("frame_no", 0.5)).first()[0]
    got = streamed(spark, [df.filter(F.col("frame_no") > cut), df.filter(F.col("frame_no") <= cut),
                           flows.end_of_input(df, "8000 DAYS")],
                   str(tmp_path / "in"), idle="365 days", late="7300 days")
    batch = reassembly.rebuild_transfers(df).collect()
    key = lambda r, name: (r["src"], r["opened"], r[name], r["complete"], bytes(r["payload"]))
    assert sorted(key(r, "filename") for r in got) == sorted(key(r, "original_filename") for r in batch)


def test_stream_ends_idle_transfers(spark, tmp_path):
    events = [(1, "a", "s", 5, 69, "one", None, 0), (2, "a", "s", 5, 69, None, "1", 512),
              (3, "a", "s", 5, 69, None, "2", 512), (7000, "a", "s", 5, 69, None, "3", 4)]
    df = packets(spark, events).withColumn("ts", F.timestamp_seconds("frame_no"))
    got = streamed(spark, [df, flows.end_of_input(df, "1 DAY")], str(tmp_path / "in"), idle="60 minutes")
    assert [(r["filename"], r["complete"], r["blocks"], bytes(r["payload"])) for r in got] == [
        ("incomplete_one", False, 2, bytes([2]) * 512 + bytes([3]) * 512)]


def test_batches_of_a_stream_may_run_again(spark, tmp_path):
    """Sessions that span batches, late and too late packets, and every batch twice."""
    w = lambda f, port, name: (f, "a", "s", port, 69, name, None, 0)
    d = lambda f, port, b, n: (f, "a", "s", port, 69, None, str(b), n)
    batches = [[w(100, 5, "one"), d(120, 5, 2, 512)],
               [d(110, 5, 1, 512), w(130, 6, "two"), d(150, 6, 1, 7)],
               [d(160, 5, 3, 9), w(500, 7, "three")],
               [d(140, 5, 9, 512), d(510, 7, 1, 4)],
               [w(5000, 8, "last")]]
    stream = flows.TransferStream(spark, str(tmp_path / "t"), "2 minutes", "1 minute")
    seen = []
    for number, events in enumerate(batches):
        for _ in range(2):
            stream(packets(spark, events), number)
        if number >= 2:
            seen.append(sorted((r["filename"], r["batch"], bytes(r["payload"])) for r in stream.transfers().collect()))
    one = bytes([110]) * 512 + bytes([120]) * 512 + bytes([160]) * 9
    assert seen[0] == [("one", 2, one), ("two", 2, bytes([150]) * 7)] == seen[1]
    assert seen[2] == sorted([("one", 2, one), ("two", 2, bytes([150]) * 7), ("three", 4, bytes([510 % 251]) * 4)])


def test_summaries_lead_to_the_starts_of_a_plain_replay():
    """Stretches of every width, reduced under any guess, end at the open transfers of one replay in order."""
    rng = random.Random(5)
    for _ in range(300):
        events = [dict(frame_no=f, sport=rng.randint(1, 4), dport=rng.randint(1, 6), is_request=rng.random() < 0.4,
                       is_short=True) for f in range(rng.randint(1, 40))]
        width = rng.randint(1, 8)
        cut = [events[i:i + width] for i in range(0, len(events), width)]
        held, want = {}, []
        for part in cut:
            want.append(list(held.items()))
            list(reassembly.replay(part, held))
        summaries = [reassembly.summarize(part, rng.sample([1, 2, 3, 4], rng.randint(0, 4))) for part in cut]
        for _ in range(len(cut) + 1):
            held, got, wrong = {}, [], []
            for i, summary in enumerate(summaries):
                got.append(list(held.items()))
                if not reassembly.holds(summary, held):
                    wrong.append((i, list(held)))
                held = reassembly.advance(summary, held)
            if not wrong:
                break
            for i, ports in wrong:
                summaries[i] = reassembly.summarize(cut[i], ports)
        assert not wrong and got == want


def test_one_pair_whose_transfer_never_ends(spark):
    """One busy period of stray blocks, cut into many stretches; the first transfer stays open throughout."""
    rng, events = random.Random(9), [(1, "a", "s", 9, 69, "open", None, 0)]
    for f in range(2, 400):
        if rng.random() < 0.15:
            events.append((f, "a", "s", rng.randint(10, 13), 69, f"f{f}", None, 0))
        else:
            events.append((f, "a", "s", rng.randint(10, 16), 69, None, str(f), rng.choice([512, 512, 512, 100])))
    assert rebuilt(packets(spark, events), width=10) == brute_force(events)
