"""DNS features: lexical ones per query, response ones per packet."""

from pyspark.sql import Column, DataFrame, functions as F

from egresslens import constants as C
from egresslens.functions import text as X
from egresslens.functions.times import millis_text
from egresslens.operators.intervals import most_specific
from egresslens.session import materialize

_ADDRESS_TYPES = (1, 28)


def lexical_features(queries: DataFrame, name: str = "dns.qname", ts: str = "ts", keep=("frame_no",)) -> DataFrame:
    """One feature row per query name; rows without a name are dropped."""
    q = F.col("__q")
    named = queries.select(*keep, F.col(ts).alias("__ts"), X.dns_name(F.col(name)).alias("__q")).dropna(subset=["__q"])
    length = F.length(q).cast("bigint")
    return named.select(
        *keep, millis_text(F.col("__ts")).alias("timestamp"), length.alias("FQDN_count"),
        X.subdomain_length(q).alias("subdomain_length"), X.count_class(q, X.UPPER).alias("upper"),
        X.count_class(q, X.LOWER).alias("lower"), X.count_class(q, X.DIGIT).alias("numeric"),
        X.entropy(q).alias("entropy"), X.count_class(q, X.SPECIAL).alias("special"),
        X.label_count(q).alias("labels"), X.label_max(q).alias("labels_max"),
        X.label_average(q).alias("labels_average"), X.longest_word_length(q).alias("longest_word"),
        X.second_level_label(q).alias("sld"), length.alias("len"), X.has_subdomain(q).alias("subdomain"))


def _addresses(rr: Column) -> Column:
    """Distinct addresses of the A and AAAA records."""
    hits = F.filter(rr, lambda r: r["type"].isin(*_ADDRESS_TYPES) & r["rdata"].isNotNull())
    return F.array_sort(F.array_distinct(F.transform(hits, lambda r: r["rdata"])))


def ip_domains(packets: DataFrame) -> DataFrame:
    """Distinct ``(ip, domain)`` over all packets that have a query name and records."""
    name = X.dns_name(F.col("dns.qname"))
    return packets.select(
        X.registered_domain(name).alias("domain"), F.explode(_addresses(F.col("dns.rr"))).alias("ip")
    ).dropna().distinct()


def _sorted_set(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))


def shared_domains(packets: DataFrame) -> DataFrame:
    """Per distinct set of addresses, all domains seen with any of them.

    Packets that carry the same addresses share one row. Equal sets of domains share a name; address
    sets meet names only, and each combination of names is resolved once, so a busy address does not
    pair all its address sets with all its domains.
    """
    sets = packets.select(_addresses(F.col("dns.rr")).alias("ips")).filter(F.size("ips") > 0).distinct()
    known = materialize(
        _sorted_set(ip_domains(packets), "ip", "domain", "domains")
        .withColumn("name", F.md5(F.to_json("domains"))), "address-domains")
    # Not written: in a file all these repeated addresses and names are so small that Spark would broadcast them,
    # and many times larger in memory. The hints are for the same reason.
    named = (sets.select("ips", F.explode("ips").alias("ip")).hint("merge").join(known.select("ip", "name"), "ip")
             .groupBy("ips").agg(F.array_sort(F.collect_set("name")).alias("names")))
    members = known.select("name", "domains").dropDuplicates(["name"]).hint("merge")
    resolved = (named.select("names").distinct().select("names", F.explode("names").alias("name"))
                .join(members, "name").groupBy("names")
                .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("domains")))
    return named.join(resolved, "names").select("ips", "domains")


def geo_lookup(addresses: DataFrame, ranges: DataFrame, key: str = "address") -> DataFrame:
    """Country and network of integer addresses by inclusive ranges ``(lo, hi, iso, asn)``, the narrowest where they nest."""
    return most_specific(addresses, ranges, key, ["iso", "asn"])


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as an integer; NULL for anything else."""
    octet = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).cast("bigint")
    value = octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), value)


def ipv6_digits(ip: Column) -> Column:
    """IPv6 text as its 32 hex digits, which sort like the addresses; NULL for anything else."""
    tail = F.regexp_extract(ip, r":(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    octets = F.transform(F.split(tail, r"\."), lambda o: F.lpad(F.hex(o.cast("bigint")), 2, "0"))
    quad = F.array_join(octets, "")
    plain = F.when(tail == "", ip).otherwise(F.concat(
        F.regexp_replace(ip, r"[\d.]+$", ""), F.substring(quad, 1, 4), F.lit(":"), F.substring(quad, 5, 4)))
    halves = F.split(F.lower(plain), "::")
    groups = lambda i: F.transform(
        F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != ""),
        lambda g: F.lpad(g, 4, "0"))
    head, rest = groups(1), groups(2)
    missing = 8 - F.size(head) - F.size(rest)
    digits = F.array_join(F.concat(head, F.array_repeat(F.lit("0000"), F.greatest(missing, F.lit(0))), rest), "")
    shaped = plain.rlike("(?i)^(?!.*:::)(?!.*::.*::)(?!:[^:])(?!:$)([0-9a-f]{0,4}:)+([0-9a-f]{1,4})?$")
    whole = F.when(F.size(halves) == 2, missing > 0).otherwise((missing == 0) & ~plain.endswith(":"))
    return F.when(shaped & whole & (F.length(digits) == 32), digits)


def geo_lookup_v6(addresses: DataFrame, ranges: DataFrame, key: str = "address") -> DataFrame:
    """As ``geo_lookup`` for the 32 digits of IPv6 addresses and ranges whose ``lo`` and ``hi`` are IPv6 text."""
    digits = ranges.select(ipv6_digits(F.col("lo")).alias("lo"), ipv6_digits(F.col("hi")).alias("hi"), "iso", "asn")
    return most_specific(addresses, digits, key, ["iso", "asn"])


def geo_sets(packets: DataFrame, ranges: DataFrame, ranges_v6: DataFrame | None = None) -> DataFrame:
    """Countries and networks per distinct set of addresses; IPv6 ones are looked up in ``ranges_v6``."""
    sets = packets.select(_addresses(F.col("dns.rr")).alias("ips")).filter(F.size("ips") > 0).distinct()
    each = sets.select("ips", F.explode("ips").alias("ip"))
    ips = each.select("ip").distinct()
    located = geo_lookup(ips.withColumn("address", ipv4_number(F.col("ip"))).dropna(), ranges).drop("address")
    if ranges_v6 is not None:
        located = located.union(geo_lookup_v6(
            ips.withColumn("address", ipv6_digits(F.col("ip"))).dropna(), ranges_v6).drop("address"))
    # As above, the file of the packets is far smaller than these rows.
    return each.hint("merge").join(located, "ip").groupBy("ips").agg(
        F.array_sort(F.collect_set("iso")).alias("countries"),
        F.array_sort(F.collect_set("asn")).alias("asns"))


def record_type_counts(rr: Column) -> dict[str, Column]:
    return {
        f"{name}_frequency": F.size(F.filter(rr, lambda r: r["type"] == F.lit(code))).cast("bigint")
        for code, name in C.RR_TYPES.items()}


def _mean(values: Column) -> Column:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    return X.let(values, lambda v: F.when(F.size(v) > 0, F.round(total(v) / F.size(v), 10)).otherwise(0.0))


def ttl_moments(ttls: Column) -> tuple[Column, Column]:
    """Mean and sample variance of integers, from exact sums."""
    wide = "decimal(38,0)"
    exact = lambda t: t.cast("decimal(19,0)")
    zero = F.lit(0).cast(wide)
    start = F.struct(zero.alias("sum"), zero.alias("squares"))
    sums = F.aggregate(ttls, start, lambda acc, t: F.struct(
        (acc["sum"] + exact(t)).cast(wide).alias("sum"),
        (acc["squares"] + (exact(t) * exact(t)).cast(wide)).cast(wide).alias("squares")))
    n, total = F.size(ttls), sums["sum"]
    spread = (sums["squares"] * n).cast(wide) - (total * total).cast(wide)
    mean = F.when(n > 0, F.round(total.cast("double") / n, 10)).otherwise(0.0)
    variance = F.when(n > 1, F.round(spread.cast("double") / (n * (n - 1)), 10)).otherwise(0.0)
    return mean, variance


def type_names(rr: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in C.RR_TYPES.items() for x in pair])
    names = F.transform(F.filter(rr, lambda r: r["type"].isNotNull()),
                        lambda r: F.coalesce(F.try_element_at(known, r["type"]), F.lit("OTHER")))
    return F.array_distinct(names)


def response_features(packets: DataFrame, ranges: DataFrame | None = None, keep=("frame_no",),
                      ranges_v6: DataFrame | None = None) -> DataFrame:
    """One feature row per packet with records; only the two set lookups are joins.

    The lookups and the rows themselves read the packets several times, so their names and records are written once.
    """
    held = packets.filter(F.size("dns.rr") > 0).select(*keep, F.struct("dns.qname", "dns.rr").alias("dns"))
    held = materialize(held, "responses")
    rr = F.col("dns.rr")
    base = held.select(*keep, rr.alias("rr"), _addresses(rr).alias("ips"))
    joined = base.join(shared_domains(held), "ips", "left")
    if ranges is None:
        joined = joined.withColumns({"countries": F.array().cast("array<string>"),
                                     "asns": F.array().cast("array<string>")})
    else:
        joined = joined.join(geo_sets(held, ranges, ranges_v6), "ips", "left")
    rr = F.col("rr")
    names = F.filter(F.transform(rr, lambda r: X.dns_name(r["name"])), lambda n: n.isNotNull())
    ttls = F.filter(F.transform(rr, lambda r: r["ttl"]), lambda t: t.isNotNull())
    # Arrays used more than once are columns of their own.
    staged = joined.select(
        *keep, "ips", "countries", "asns", "domains", F.size(rr).cast("bigint").alias("rr_count"),
        names.alias("names"), ttls.alias("ttls"), type_names(rr).alias("types"),
        *[c.alias(n) for n, c in record_type_counts(rr).items()])
    a, aaaa = F.col("A_frequency"), F.col("AAAA_frequency")
    mean, variance = ttl_moments(F.col("ttls"))
    listed = lambda name: X.as_json(F.coalesce(F.col(name), F.array().cast("array<string>")))
    return staged.select(
        *keep, F.when(a + aaaa > 0, F.round(a / (a + aaaa), 10)).otherwise(0.0).alias("rr"),
        *[f"{n}_frequency" for n in C.RR_TYPES.values()], X.as_json(F.col("types")).alias("rr_type"),
        "rr_count", _mean(F.transform("names", lambda n: X.entropy(n, 15))).alias("rr_name_entropy"),
        _mean(F.transform("names", lambda n: F.length(n).cast("double"))).alias("rr_name_length"),
        F.col("NS_frequency").alias("distinct_ns"), F.size("ips").cast("bigint").alias("distinct_ip"),
        listed("countries").alias("unique_country"), listed("asns").alias("unique_asn"),
        listed("domains").alias("distinct_domains"), F.lit("unknown").alias("reverse_dns"),
        a.alias("a_records"), X.as_json(F.array_distinct("ttls")).alias("unique_ttl"),
        mean.alias("ttl_mean"), variance.alias("ttl_variance"))
