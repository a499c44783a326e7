"""Classifier, reputation, language models and sharding against plain loops and dictionaries."""

from collections import Counter, defaultdict
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from egresslens.llm import host_reputation, language_id, quality_classifier, quality_rules, queries, shard_table, warc

WORDS = ["ka", "lo", "mi", "ta", "zur", "xen", "qop", "vul", "!", "é"]


# --- classifier --------------------------------------------------------------------------------

def plain_features(text, bits):
    tokens = re.findall(r"\w+|[^\w\s]", text.lower())
    mask = (1 << 64) - 1
    one, before = [], None
    for token in tokens:
        value = xxhash.xxh64_intdigest(token)
        one.append(int(quality_classifier.REPEATED) if value == before else value)
        before = value
    counts, mix = Counter(), int(quality_classifier.MIX)
    for value in one:
        counts[(value * mix & mask) >> (64 - bits)] += 1
    for a, b in zip(one, one[1:]):
        counts[((a * mix + (b ^ (b >> 31))) * mix & mask) >> (64 - bits)] += 1
    values = {k: math.log(1 + n) for k, n in counts.items()}
    length = math.sqrt(sum(v * v for v in values.values()))
    return {k: v / length for k, v in values.items()}


def plain_ftrl(examples, params):
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= params.l1:
            return 0.0
        return -(z[k] - math.copysign(params.l1, z[k])) / ((params.beta + math.sqrt(n[k])) / params.alpha + params.l2)
    for _ in range(params.epochs):
        for features, label in examples:
            x = {**features, "bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / params.alpha * w[k]
                n[k] += g * g
    return weight, list(z)


def test_classifier_equals_dictionary_loops(spark):
    draw = random.Random(2)
    params = quality_classifier.Params(bits=10, epochs=2)
    texts = [" ".join(draw.choices(WORDS[:6] if i % 2 else WORDS[3:], k=draw.randint(0, 12))) for i in range(40)] + ["ka ka ka ka"]
    features = quality_classifier.Features(params.bits)
    examples = [(*features(t), i % 2) for i, t in enumerate(texts)]
    for (buckets, values, _), text in zip(examples, texts):
        assert dict(zip(buckets.tolist(), values)) == pytest.approx(plain_features(text, params.bits))
    weights = quality_classifier.fit(examples, params)
    weight, known = plain_ftrl([(plain_features(t, params.bits), i % 2) for i, t in enumerate(texts)], params)
    assert weights[-1] == pytest.approx(weight("bias"), abs=1e-5)
    assert all(weights[k] == pytest.approx(weight(k), abs=1e-5) for k in known if k != "bias")
    assert np.count_nonzero(weights) == sum(weight(k) != 0 for k in known)
    df = spark.createDataFrame([*enumerate(texts), (97, None)], "doc_id long, text string")
    for r in quality_classifier.score(df, weights).collect():
        x = plain_features(r["text"] or "", params.bits) if r["text"] else {}
        dot = weight("bias") + sum(weight(k) * v for k, v in x.items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-5)


# --- host reputation ---------------------------------------------------------------------------

def plain_strength(groups, params):
    """groups: (parent, n, good) of the groups of a level; moments of the nested layout."""
    groups = [g for g in groups if g[1]]
    parents = defaultdict(list)
    for parent, n, good in groups:
        parents[parent].append((n, good))
    free, total = len(groups) - len(parents), sum(n for _, n, _ in groups)
    if not groups or not free or total <= len(groups):
        return params.strongest
    between = within = share_of_squares = 0.0
    for held in parents.values():
        size, good = sum(n for n, _ in held), sum(g for _, g in held)
        between += sum(n * (g / n - good / size) ** 2 for n, g in held)
        within += sum(g - g * g / n for n, g in held)
        share_of_squares += sum(n * n for n, _ in held) / size
    between, within, each = between / free, within / (total - len(groups)), (total - share_of_squares) / free
    share = (between - within) / (between + (each - 1) * within) if between + (each - 1) * within > 0 else 0
    return min(params.strongest, max(params.weakest, 1 / share - 1)) if share > 0 else params.strongest


def test_posterior_equals_plain_sums(spark):
    draw, params = random.Random(7), host_reputation.Params()
    rates = {}
    urls, good = [], []
    for i in range(900):
        domain = f"d{draw.randrange(12)}.{draw.choice(['com', 'org', 'net'])}"
        host = f"h{draw.randrange(4)}.{domain}"
        rate = rates.setdefault(host, min(1, max(0, rates.setdefault(domain, draw.random()) + draw.uniform(-0.2, 0.2))))
        urls.append(draw.choice([f"http://{host}/x", f"https://{host}?q", f"HTTP://{host.upper()}#f"]))
        good.append(draw.choice([None, None, int(draw.random() < rate)]))
    urls += [None, "nothing", urls[0]]
    good += [1, 0, None]
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, n double")
    outcomes = spark.createDataFrame([(i, g) for i, g in enumerate(good)] + [(3, 1), (3, 0), (None, 1)], "page_id long, good int")
    held = defaultdict(list)
    for i, g in [*enumerate(good), (3, 1), (3, 0)]:
        if g is not None:
            held[i].append(g)
    host_of = lambda u: re.split(r"[/?#]", u.split("://", 1)[1], maxsplit=1)[0].lower() if u and "://" in u else ""
    hosts = {host_of(u): [0, 0.0] for u in urls}
    for i, gs in held.items():
        hosts[host_of(urls[i])][0] += 1
        hosts[host_of(urls[i])][1] += sum(gs) / len(gs)
    domain_of, suffix_of = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]
    domains, suffixes = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for h, (n, g) in hosts.items():
        for table, key in ((domains, domain_of(h)), (suffixes, suffix_of(h))):
            table[key][0] += n
            table[key][1] += g
    pull = {"host": plain_strength([(domain_of(h), *x) for h, x in hosts.items()], params),
            "domain": plain_strength([(suffix_of(d), *x) for d, x in domains.items()], params),
            "suffix": plain_strength([("", *x) for x in suffixes.values()], params)}
    total = sum(n for n, _ in hosts.values()), sum(g for _, g in hosts.values())
    mean = (total[1] + 0.5) / (total[0] + 1)
    for r in host_reputation.judge(pages, outcomes, [], []).collect():
        h = host_of(urls[r["page_id"]])
        towards = mean
        for level, (n, g) in (("suffix", suffixes[suffix_of(h)]), ("domain", domains[domain_of(h)]), ("host", hosts[h])):
            towards = (g + pull[level] * towards) / (n + pull[level])
        bound = towards - params.z * math.sqrt(towards * (1 - towards) / (hosts[h][0] + pull["host"] + 1))
        assert (r["mean"], r["bound"]) == (pytest.approx(towards), pytest.approx(bound))
        assert r["verdict"] == ("allow" if bound >= params.least else "block")


# --- language models ---------------------------------------------------------------------------

def test_kneser_ney_equals_dictionaries():
    texts = {"x": "ka lo mi ka lo ta mi lo", "y": "zur xen qop zur vul xen zur"}
    cut = language_id.Cutter()
    held = {lang: np.unique(language_id.grams(cut.padded(t)), return_counts=True) for lang, t in texts.items()}
    model = language_id.Model(held)
    plain, alphabet = {}, set()
    for lang, text in texts.items():
        padded = "   " + text + " "
        counts = {4: Counter(padded[i:i + 4] for i in range(len(padded) - 3))}
        for order in (3, 2, 1):  # in how many ways a shorter gram goes on to the left
            counts[order] = Counter(g[1:] for g in counts[order + 1])
        alphabet |= set(counts[1])
        plain[lang] = counts

    def probability(lang, gram):
        if not gram:
            return 1 / (1 + len(alphabet))
        counts = plain[lang][len(gram)]
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        inside = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        total, below = sum(inside.values()), probability(lang, gram[1:])
        if not total:
            return below
        return max(inside.get(gram, 0) - discount, 0) * (gram in inside) / total + discount * len(inside) / total * below

    for text in ("ka lo", "zur mi", "qqq", "lo"):
        lengths, h = model.entropies([text], cut)
        padded = "   " + text + " "
        each = [padded[i:i + 4] for i in range(len(padded) - 3)]
        assert lengths[0] == len(each)
        for column, lang in enumerate(model.languages):
            assert h[0, column] == pytest.approx(-sum(math.log(probability(lang, g)) for g in each) / len(each), abs=1e-4)


# --- sharding ----------------------------------------------------------------------------------

def test_slots_and_shards_by_hand(spark):
    """Slots from md5 and the filled table by hand; nulls, repeated rows, clashing columns, no rows."""
    names, slots = [f"s{i}" for i in range(5)], 101
    orders = []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        start, skip = int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
        orders.append(iter([(start + skip * k) % slots for k in range(slots)]))
    owner = {}
    while len(owner) < slots:
        for name, order in zip(names, orders):
            if len(owner) < slots:
                owner[next(s for s in order if s not in owner)] = name
    rows = [(i, "slot", 1) for i in range(50)] + [(None, "x", 2), (7, "again", 3)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, slot int")
    got = shard_table.place(df, list(reversed(names)), slots=slots).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % slots
        assert (r["slot"], r["shard"]) == (slot, owner[slot])
    assert shard_table.place(df.limit(0), names, slots=slots).count() == 0


# --- rules and archives ------------------------------------------------------------------------

def test_sole_rules_and_their_ablation(spark):
    names = [n for n, _ in quality_rules.RULES]
    book = spark.createDataFrame([(b,) for b in (0, 1, 1, 2, 3, 4, 8, 32, 33)], "fail_bits long")
    found = book.select("fail_bits", quality_rules.sole_rule("v1").alias("sole")).collect()
    counted = [names.index(n) for n in quality_rules.POLICIES["v1"]]
    for r in found:
        failed = [names[i] for i in counted if r["fail_bits"] >> i & 1]
        assert r["sole"] == (failed[0] if len(failed) == 1 else None)
    alone = {r["rule"]: r["removed_alone"] for r in quality_rules.ablations(book, "v1").collect()}
    assert alone == {n: sum(r["sole"] == n for r in found) for n in quality_rules.POLICIES["v1"]}


@pytest.mark.parametrize("broken", ["WARC-Type", "WARC-Record-ID", "WARC-Block-Digest", "WARC-Payload-Digest", "Content-Length"])
def test_records_without_a_field_are_damaged(broken):
    whole = warc.record(1, "http://x/", b"payload", hashlib.sha1(b"payload").hexdigest(), 7, None)
    if whole[:2] == b"\x1f\x8b":
        import gzip
        whole = gzip.decompress(whole)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = [x for x in head.split(b"\r\n") if not x.startswith(broken.encode() + b":")]
    with pytest.raises(warc.Damaged):
        warc.read_record(iter([b"\r\n".join(lines) + b"\r\n\r\n" + rest]))
