"""Chat windows, collocations, alignment and the recurrent net against plain versions."""

from collections import Counter
from dataclasses import replace
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from egresslens.llm import alignment, chat_format, collocations, gru_lm, queries
from egresslens.llm.byte_bpe import read_vocabulary
from egresslens.llm.common import table
from ..conftest import SF

VOCABULARY = read_vocabulary(public_tokenizers.path(queries.VOCABULARY))


# --- chats -------------------------------------------------------------------------------------

CONTROL = ["[INST]", "[/INST]", "[SYS]", "<s>", "</s>", "[ROLE]", "\\", "[", "<", "INST]", "s>", "/", " a", "é"]


def test_escaping_is_reversible_and_hides_control_strings():
    draw = random.Random(4)
    for _ in range(2000):
        turns = [(draw.choice(["user", "assistant", "system", "", "tool", "".join(draw.choices(CONTROL, k=2))]),
                  "".join(draw.choices(CONTROL, k=draw.randint(0, 8)))) for _ in range(draw.randint(0, 4))]
        formatted = "".join(chat_format.format_turn(*t)[0] for t in turns)
        assert chat_format.parse_turns(formatted) == turns
    with pytest.raises(ValueError):
        chat_format.parse_turns("[INST]open")


def conversation_digest(rows):
    """conv_id to (n_turns, turns, loss_chars, loss), by sorting and joining."""
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = {}
    for conv, turns in held.items():
        turns = [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def digest_columns(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("params", [chat_format.Params(), chat_format.Params(budget=64, stretch=500),
                                    chat_format.Params(budget=64, stretch=1500, history=0)])
def test_windows_give_back_every_conversation(spark, params):
    """Null ids, turns, roles and texts, equal turns, repeated rows, control strings, clashing columns; with stretches of a
    few turns, one conversation is cut many times."""
    draw, rows = random.Random(1), []
    for conv in [None, *range(25)]:
        for turn in range(draw.choice([1, 2, 5, 30, 150])):
            rows.append((conv, draw.choice([turn, turn, None]) if turn else 0,
                         draw.choice(["user", "assistant", "assistant", None, "tool</s>"]) if turn else draw.choice(["system", "user"]),
                         draw.choice([None, "", "a b " * draw.randint(0, 50), "[INST]\\[/INST] <s>", " y " * draw.randint(0, 300)])))
            if draw.random() < 0.05:
                rows.append(rows[-1])
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "conv_id long, turn long, role string, text string, key string, stretch int").repartition(5)
    windows = chat_format.windows(turns, VOCABULARY, public_tokenizers.PATTERN, params)
    assert digest_columns(chat_format.digests(windows)) == conversation_digest(rows)
    found = windows.collect()
    assert all(w["n_tokens"] <= params.budget or w["over"] for w in found)
    for w in found:
        held = chat_format.parse_turns(w["formatted"])
        new = held[w["n_repeated"]:]
        assert not w["over"] or len(held) == 1 or len(new) == 1
        assert len(w["loss"]) == sum(role == "assistant" for role, _ in new)
        assert w["n_repeated"] <= params.history + 1
    assert chat_format.digests(chat_format.windows(turns.limit(0), VOCABULARY, public_tokenizers.PATTERN, params)).count() == 0


def test_later_windows_repeat_the_system_turn_and_some_history():
    costs = np.array([5, 10, 10, 10, 10, 40, 3])
    params = chat_format.Params(budget=50, history=1)
    assert chat_format.spans(costs, 0, 0, params) == [
        (False, 0, 0, 5), (True, 5, 5, 7)]
    assert chat_format.spans(costs[1:5], 0, None, replace(params, budget=25)) == [(False, 0, 0, 2), (False, 2, 2, 4)]
    assert chat_format.spans(np.array([2, 2, 2, 2, 2]), 0, 0, chat_format.Params(budget=8, history=1)) == [
        (False, 0, 0, 4), (True, 3, 4, 5)]


def test_chat_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, i, role, queries.CONTROL_TEXT) for i, role in enumerate(("user", "assistant"))]
    assert digest_columns(queries.op11(spark, SF)) == conversation_digest(rows)


# --- collocations ------------------------------------------------------------------------------

def plain_collocations(rows, params):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in collocations.PIECE_ENDS:
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for size in range(1, params.longest + 1):
                for i in range(len(words) - size + 1):
                    key = lang, tuple(words[i:i + size])
                    counts[key] = counts.get(key, 0) + 1
    frequent = {k: n for k, n in counts.items() if n >= params.least}
    out = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        cuts = [(params.scale * a // (frequent[lang, words[:k]] + frequent[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        longer = [n for (x, w), n in frequent.items() if x == lang and len(w) > len(words)
                  and any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))]
        if not any(100 * n >= params.covered * a for n in longer):
            out.append((lang, " ".join(words), a, frequent[lang, words[:k]], frequent[lang, words[k:]], totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    ranked = []
    for row in out:
        ranks[row[0]] += 1
        if ranks[row[0]] <= params.top:
            ranked.append((row[0], ranks[row[0]], *row[1:]))
    return ranked


@pytest.mark.parametrize("bits", [1 << 10, 64])
def test_collocations(spark, bits):
    """Small flushes and tables so full that hardly anything is pruned; null texts and languages, repeated rows."""
    draw = random.Random(6)
    vocabulary = ["the", "The", "cat", "cat,", "sat", "on.", "on", "mat\tmat", "\x0b", "é", "É", "\x1c", "x\x00y", "a b"]
    texts = [" ".join(draw.choices(vocabulary, [9, 3, 6, 2, 5, 1, 4, 2, 1, 3, 1, 1, 1, 1], k=draw.randint(0, 60))) for _ in range(80)]
    rows = [(draw.choice(["en", "en", "de", None]), t) for t in texts] + [("en", None), ("xx", ""), ("en", texts[0]), ("en", texts[0])]
    params = collocations.Params(least=5, top=12, flush=90, gathered=50, gathered_phrases=120, bits=bits)
    docs = spark.createDataFrame([(i, t, lang, "p", 1) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    got = collocations.collocations(docs, params).collect()
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == plain_collocations(rows, params)
    for r in got:  # the pointer leads to the phrase
        words = [w.decode() for w in collocations.pieces_and_words(rows[r["doc_id"]][1]) if w != b"."]
        assert " ".join(words[r["place"]:r["place"] + len(r["phrase"].split(" "))]) == r["phrase"]
    assert collocations.collocations(docs.limit(0), params).count() == 0


def test_phrases_of_one_fingerprint_part():
    flush = collocations.Flush([[b"a", b"b", b"a", b"b"], [b"a", b"b"]], ["x", "y"])
    same = np.zeros(len(flush.words), np.uint64)
    at, n = flush.phrases(2, same, np.array([0, 1, 2, 5]))
    found = Counter()
    for place, many in zip(at.tolist(), n.tolist()):
        found[int(flush.lang[place]), tuple(flush.words[place:place + 2].tolist())] += many
    assert found == {(0, (1, 2)): 2, (0, (2, 1)): 1, (1, (1, 2)): 1}


def test_blocks_of_fingerprints_give_back_their_counts():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 5000, dtype=np.uint64))
    batch = collocations._packed([(keys, np.full(5000, 3)), (keys[::7], np.full(len(keys[::7]), 300))], 256)
    got = [collocations._unpacked(b) for b in batch.column(1).to_pylist()]
    found, n = (np.concatenate(x) for x in zip(*got))
    want = Counter(dict.fromkeys(keys.tolist(), 3))
    want.update(dict.fromkeys(keys[::7].tolist(), 300))
    assert dict(zip(found.tolist(), n.tolist())) == {k: min(v, 255) for k, v in want.items()}
    assert (found[:-1] < found[1:]).all() and batch.num_rows == len(set((keys >> np.uint64(32)).tolist()))


def test_blocks_of_phrases_are_small_and_give_back_their_rows():
    draw = random.Random(8)
    rows = 20_000
    phrases = sorted({" ".join(draw.choices(["the", "é", "x\x00y", "cat", "on"], k=2)) + f" w{i}" for i in range(rows)})
    kinds = {pa.int64(): lambda i: 10 * i, pa.string(): lambda i: f"d{i}", pa.float64(): lambda i: i / 7}
    for kind, made in kinds.items():
        ids = [None if i % 50 == 0 else made(draw.randrange(2000)) for i in range(rows)]
        table = pa.table({"range": pa.array([draw.randrange(8) for _ in range(rows)], pa.int32()),
                          "lang": [draw.choice(["de", "en", ""]) for _ in range(rows)], "phrase": phrases[1:] + [""],
                          "n": [draw.choice([1, 1, 1, 2, 1 << 40]) for _ in range(rows)], "doc_id": pa.array(ids, kind),
                          "place": [None if i % 70 == 0 else draw.randrange(400) for i in range(rows)]})
        batch = collocations._blocks(table)
        assert batch.column("place").to_pylist() == list(range(8))
        got = pa.concat_tables(collocations._rows(place, block, table.schema)
                               for place, block in zip(*(c.to_pylist() for c in batch.columns)))
        order = lambda t: sorted(t.to_pylist(), key=lambda r: r["phrase"])
        assert got.schema == table.schema and order(got) == order(table)
        if pa.types.is_integer(kind):  # with eight bytes of a fingerprint in each row it would be more
            assert sum(len(b) for b in batch.column("block").to_pylist()) < 11 * rows


def test_a_cut_is_scored_from_its_two_parts(spark):
    """The joins of cuts carry no whole phrase beside its parts; sizes and places of cuts come back."""
    counted = spark.createDataFrame(
        [("en", 0, "", 900)] + [("en", 1, w, n) for w, n in (("a", 100), ("b", 80), ("c", 50), ("d", 40))]
        + [("en", 2, "a b", 60), ("en", 2, "b c", 45), ("en", 2, "c d", 40), ("en", 3, "a b c", 31)],
        "lang string, size int, phrase string, n long")
    found = collocations.scored(counted)
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["n"], r["score"], r["size"]) for r in found.collect()}
    assert got == {"a b": (60, 100, 80, 900, 666666, 2), "b c": (45, 80, 50, 900, 692307, 2),
                   "c d": (40, 50, 40, 900, 888888, 2), "a b c": (31, 100, 45, 900, 427586, 3)}


# --- alignment ---------------------------------------------------------------------------------

TEXTS = [None, "", "one", "  two  spaces ", "▁x", "😀😀 x", " " * 700 + "x", "é" * 300, "=-" * 400, "\x00a\n\n b\t c ",
         "the cat sat on the mat", "the cat sat on the mat", "中文 and ａ", "</s><|endoftext|>"]


def plain_alignment(texts):
    """Per text: digest columns, from both libraries and byte offsets."""
    a_side = Tokenizer.from_file(public_tokenizers.path(queries.ALIGNED_A))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.ALIGNED_B))
    tokens = alignment.read_byte_level(public_tokenizers.path(queries.ALIGNED_A))
    piece = lambda i: (bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i)
                       else b_side.id_to_piece(i).replace("▁", " ").encode())
    found = []
    for text in texts:
        a = [(i, tokens[i]) for i in a_side.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, piece(i)) for i in b_side.encode(text)] if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        groups, links, upto = [], Counter(), [0, 0]
        for cut in sorted(ends[0] & ends[1]):
            group = []
            for side, rest in enumerate((a, b)):
                own = []
                while upto[side] < cut:
                    i, x = rest.pop(0)
                    own.append(i)
                    upto[side] += len(x)
                group.append(own)
            groups.append(group)
            links.update((x, y) for x in group[0] for y in group[1])
        found.append((groups, links))
    counts = Counter(pair for _, links in found for pair in links)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [(sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
             sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()),
             hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
             if groups else "") for groups, links in found]


@pytest.mark.parametrize("block, large", [(alignment.EXPANDED, alignment.LARGE), (7, 3)])
def test_alignment(spark, monkeypatch, block, large):
    """Counts in one block and in many, groups expanded token by token and by distinct ids."""
    monkeypatch.setattr(alignment, "LARGE", large)
    tokens = alignment.read_byte_level(public_tokenizers.path(queries.ALIGNED_A))
    model = read_vocabulary(public_tokenizers.path(queries.ALIGNED_B))
    docs = spark.createDataFrame([(i, t, "g", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, groups string, a int")
    found = alignment.link_statistics(docs, tokens, public_tokenizers.PATTERN, model, block)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r[c] for c in columns) for r in found.orderBy("doc_id").collect()] == plain_alignment(TEXTS)
    assert alignment.link_statistics(docs.limit(0), tokens, public_tokenizers.PATTERN, model).count() == 0


def test_large_groups_expand_to_the_same_pairs(monkeypatch):
    draw = np.random.default_rng(3)
    groups_a, groups_b = np.sort(draw.integers(0, 9, 80)), np.sort(draw.integers(0, 9, 90))
    groups_a, groups_b = (np.sort(np.concatenate([g, np.arange(9)])) for g in (groups_a, groups_b))
    ids_a, ids_b = draw.integers(0, 6, len(groups_a)), draw.integers(0, 5, len(groups_b))
    docs = np.array([0, 0, 0, 1, 1, 2, 2, 2, 2])
    plain = Counter((int(docs[g]), int(a), int(b)) for a, g in zip(ids_a, groups_a) for b, h in zip(ids_b, groups_b) if g == h)
    for large, expanded in ((1 << 30, 1 << 30), (0, 1 << 30), (0, 7), (40, 10)):
        monkeypatch.setattr(alignment, "LARGE", large)
        monkeypatch.setattr(alignment, "EXPANDED", expanded)
        keys, times = alignment.expand(ids_a, ids_b, groups_a, groups_b, docs, 5)
        got = {(k // (5 << 32), k % (5 << 32) // 5, k % (5 << 32) % 5): n for k, n in zip(keys.tolist(), times.tolist())}
        assert got == plain and (keys[:-1] < keys[1:]).all()


def test_stretches_encode_as_whole_texts():
    tokens = alignment.read_byte_level(public_tokenizers.path(queries.ALIGNED_A))
    sides = alignment.Sides(tokens, public_tokenizers.PATTERN, read_vocabulary(public_tokenizers.path(queries.ALIGNED_B)))
    draw = random.Random(8)
    texts = ["".join(draw.choices("ab é\n\t .,'s1😀  \x1c\x85 　中한", k=draw.randint(1, 25))) for _ in range(3000)]
    counts, ids = sides.encode(texts)
    at = np.concatenate([[0], np.cumsum(counts[0])]), np.concatenate([[0], np.cumsum(counts[1])])
    for i, text in enumerate(texts):
        a, b = sides.a.encode_ordinary(" " + text), sides.b.encode(text, out_type=int)
        if b"".join(sides.bytes[1][x] for x in b) != (" " + text).encode():
            a, b = [], []
        assert [ids[s][at[s][i]:at[s][i + 1]].tolist() for s in (0, 1)] == [a, b]


# --- the recurrent net -------------------------------------------------------------------------

def small_net(known):
    """``known`` words and room for eight heads, so that a class may have fewer words than places."""
    params = gru_lm.Params(state=3, heads=8, width=4, tails=3, known=known, lanes=3, window=5)
    words = [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h", b"zz", b"q"][:known]
    tails = np.array([gru_lm.tail_class(w, params.tails) for w in words])
    counts = np.arange(known + 1, 1, -1)
    lex = gru_lm.Lexicon(words, counts, tails, int(counts.sum()), len(words), np.bincount(tails, counts, params.tails),
                         np.bincount(tails, minlength=params.tails), params)
    weights = {k: np.random.default_rng(i).normal(0, 0.5, v.shape).astype(np.float32)
               for i, (k, v) in enumerate(gru_lm.fresh_weights(params).items())}
    return params, lex, weights


def plain_log_likelihood(symbols, w, size, params):
    """Natural log of the net's part of a text, one number at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, total, given = np.zeros(params.state), 0.0, params.heads + params.tails
    for target in symbols:
        a, g = w["inputs"][given].astype(float), h @ w["state"].astype(float)
        n = params.state
        z, r = sigmoid(a[:n] + g[:n]), sigmoid(a[n:2 * n] + g[n:2 * n])
        new = np.tanh(a[2 * n:] + r * g[2 * n:])
        h = (1 - z) * new + z * h
        scores = h @ w["classes"].astype(float) + w["class_bias"]
        kind = target // params.width if target < params.heads else params.head_classes + target - params.heads
        total += scores[kind] - np.log(np.exp(scores).sum())
        if target < params.heads:
            own = range(kind * params.width, min((kind + 1) * params.width, size))
            inner = {i: w["heads"][i].astype(float) @ h + w["head_bias"][i] for i in own}
            total += inner[target] - np.log(sum(np.exp(list(inner.values()))))
        given = target
    return total


@pytest.mark.parametrize("known", [10, 6])
def test_network_scores_equal_plain_loops(known):
    params, lex, w = small_net(known)
    texts = ["a b c d e f g h zz a", "", None, "a " * 40 + "q", "h g f e"]
    n, known, base, part, rare = gru_lm.document_scores(texts, lex.places(), lex, w, params)
    places = lex.places()
    for i, text in enumerate(texts):
        ranks = [places[t] for t in gru_lm.tokens(text)]
        symbols = [int(lex.symbol[r]) if r >= 0 else params.heads - 1 - r for r in ranks]
        tails = [(r, s - params.heads) for r, s in zip(ranks, symbols) if s >= params.heads]
        want = plain_log_likelihood(symbols, w, lex.size, params) / np.log(10)
        want += sum((lex.log_count[r] if r >= 0 else 0) - lex.tail_total[k] for r, k in tails)
        assert part[i] == pytest.approx(want, abs=1e-4)
        assert n[i] == len(ranks) and known[i] == sum(r >= 0 for r in ranks) and sum(rare[i].values()) == n[i] - known[i]


@pytest.mark.parametrize("known", [10, 6])
def test_gradients_equal_finite_differences(known):
    params, lex, w = small_net(known)
    draw = random.Random(1)
    docs = [np.array([draw.randrange(lex.size) if draw.random() < 0.7 else params.heads + draw.randrange(params.tails)
                      for _ in range(k)], np.int32) for k in (9, 4, 6, 2)]
    inputs, targets, starts, _, valid = next(gru_lm.Lanes(docs, 3, params).windows(params.window))
    state = np.random.default_rng(9).normal(0, 0.5, (inputs.shape[1], params.state)).astype(np.float32)
    loss = lambda v: gru_lm.gradients(v, inputs, targets, starts, valid, state, lex.size, params)[0]
    _, g, _ = gru_lm.gradients(w, inputs, targets, starts, valid, state, lex.size, params)
    for name in gru_lm.FIELDS:
        for place in list(np.ndindex(w[name].shape))[:40]:
            sides = []
            for step in (1e-2, -1e-2):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][place] += step
                sides.append(loss(moved))
            assert g[name][place] == pytest.approx((sides[0] - sides[1]) / 2e-2, abs=2e-4), (name, place)


@pytest.mark.parametrize("known", [10, 6, 0])
def test_batches_of_texts_have_the_numbers_of_their_tokens(known):
    params, lex, _ = small_net(known) if known else (*small_net(1)[:1], None, None)
    lex = lex or gru_lm.Lexicon([], np.zeros(0, int), np.zeros(0, int), 0, 0, np.zeros(3), np.zeros(3), params)
    places = lex.places()
    texts = [None, "", " \t ", "a B  zz\x0bzz\x1cq É\x85é", "\n\r\x0c", "h new new a", " \x1f ", "H"]
    ranks, sizes, others = places.ranks(pa.array(texts, pa.string()))
    want = [gru_lm.tokens(t) for t in texts]
    assert ranks.tolist() == [places[w] for words in want for w in words] and sizes.tolist() == [len(w) for w in want]
    assert others.to_pylist() == [w for words in want for w in words[:-1] if places[w] < 0]
    sliced = pa.array(["gone", *texts], pa.string()).slice(1)
    assert places.ranks(sliced)[0].tolist() == ranks.tolist()


def test_words_are_counted_by_batch(spark):
    texts = ["A a b", None, "", " ", "b\x0bc\x1cd é É", "a"] * 3
    params = gru_lm.Params()
    counts = gru_lm.count_words(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), params)
    plain = Counter(w for t in texts for w in gru_lm.tokens(t))
    assert {bytes(r["word"]): (r["tail"], r["n"]) for r in counts.collect()} == {
        w: (gru_lm.tail_class(w, params.tails), n) for w, n in plain.items()}


def test_softmax_with_one_shift_keeps_rows_far_below_it():
    x = np.array([[300, 299, 0], [-300, -301, -302], [1, 2, -np.inf]], np.float32)
    own = np.arange(3), np.array([1, 2, 0])
    for rows in (slice(0, 3), slice(2, 3), slice(0, 0)):
        y = x[rows].astype(float)
        want = y[np.arange(len(y)), own[1][rows]] - np.log(np.exp(y - y.max(axis=1, keepdims=True)).sum(axis=1)) - y.max(axis=1)
        shares, total, found = gru_lm._exponents(x[rows].copy(), (np.arange(len(y)), own[1][rows]))
        assert found == pytest.approx(want, abs=1e-4)
        assert (shares / total[:, None]).sum(axis=1) == pytest.approx(np.ones(len(y)), abs=1e-5)
