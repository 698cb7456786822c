"""Each operator against a brute-force version, on every awkward case."""

import hashlib
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metricloom.llm import chat, jaccard_join, license_scan, line_crf, line_dedup, mixing, ngram_lm, pieces, suffix_dedup, textscan, topk
from metricloom.llm.components import components

from .conftest import SCHEMA, clashing

SPACED = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def pairs_of(df, key, *columns):
    return sorted((repr(tuple(r[c] for c in (key, *columns))) for r in df.collect()))


# 1 ---------------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows, nothing):
    got = mixing.taken(clashing(docs, "size", "copies", "target")).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(SPACED, t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # Targets by giving out again what lies above twice the size, until nothing does.
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    biggest = max(len(re.findall(SPACED, t or "")) for _, t, *_ in rows)
    for s in order:
        assert abs(taken[s] - target[s]) <= biggest
    again = mixing.taken(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.taken(nothing).count() == 0


def test_mixing_is_unbiased_and_has_levels(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("w " * 3).alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    r = mixing.taken(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.countDistinct("copies").alias("n")).collect()
    assert all(abs(x["t"] - x["w"]) <= 3 for x in r)


def test_mixed_rows(docs, nothing):
    got = mixing.mixed(docs)
    want = mixing.taken(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n"))
    assert got.columns == docs.columns and got.count() == want.agg(F.sum("n")).first()[0]
    assert mixing.mixed(nothing).count() == 0
    assert sorted(map(repr, mixing.mixed(docs.repartition(7)).collect())) == sorted(map(repr, got.collect()))


def test_mixing_plan_is_native(docs):
    plan = mixing.taken(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 2 ---------------------------------------------------------------------------------------------


def test_license_scan(docs, rows, nothing):
    got = Counter(repr(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))) for r in license_scan.scan(clashing(docs, "score", "labels")).collect())
    want = Counter()
    for d, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        want[repr((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))] += 1
    assert got == want and license_scan.scan(nothing).count() == 0


def test_license_templates_are_found(spark):
    texts = [text for _, text, _ in license_scan.TEMPLATES] + ["nothing of the kind in this software"]
    df = spark.createDataFrame([(i, f"Some words before it. {t.upper()} And after.") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for i, (label, _, _) in enumerate(license_scan.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    assert got[len(texts) - 1]["labels"] == "" and got[len(texts) - 1]["score"] == 0
    assert set(filter(None, got[0]["base_labels"].split(","))) <= set(got[0]["labels"].split(","))


def test_license_search_beside_an_exhaustive_one(spark):
    """Templates whole, cut at either end, with words put in, between other words: what any start would give."""
    import random

    import numpy as np

    r = random.Random(6)
    filler = "the of to in and or software use any for with code word other file".split()
    texts = []
    for _, text, _ in license_scan.TEMPLATES * 12:
        w = text.split()
        w = w[r.choice([0, 0, 1, 3, 6]) : len(w) - r.choice([0, 0, 1, 3, 6])]
        for _ in range(r.choice([0, 0, 1, 2])):
            w.insert(r.randrange(len(w) + 1), r.choice(filler))
        texts.append(" ".join([r.choice(filler) for _ in range(r.choice([0, 0, 5, 40]))] + w + [r.choice(filler) for _ in range(r.choice([0, 5]))]))
    texts += [" ".join(r.choice(filler) for _ in range(60)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: set(filter(None, x["labels"].split(","))) for x in license_scan.scan(df).collect()}
    want, all_ = {}, license_scan.templates()
    for i, text in enumerate(texts):
        h = license_scan._hashes(text)
        stands = lambda phrase, at, h=h: at >= 0 and at + len(phrase) <= len(h) and np.array_equal(h[at : at + len(phrase)], phrase)
        reach = lambda x: range(0 if x.base else -license_scan.SLACK, 1 if x.base else license_scan.SLACK + 1)
        want[i] = {x.label for x in all_ if any(all(any(stands(phrase, s + place + off) for off in reach(x)) for phrase, place in x.keys) for s in range(-len(x.words), len(h) + 1))}
    assert all(got[i] <= want[i] for i in got)
    found, there = sum(len(got[i]) for i in got), sum(len(x) for x in want.values())
    assert there > 90 and found >= 0.98 * there
    heads = ["GNU General Public License", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1", "subject to the terms of the Mozilla Public License v 2.0"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(heads)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x["labels"] for x in rows] == ["gpl", "lgpl", "mpl-2"]


# 3 ---------------------------------------------------------------------------------------------


def test_classifier(spark, docs, nothing):
    good = [(i, "The rain in Spain stays mainly in the plain, said number %d of them all.\n" % i * 3, "en") for i in range(200)]
    bad = [(1000 + i, "X9$ || QQ!! ## zz%% 8-8-8 WWW @@ " * 5, "en") for i in range(10)]
    other = [(2000, "Ganz andere Sprache", "de"), (2001, None, "en"), (2002, "", None), (2003, "x", "en")]
    df = spark.createDataFrame(good + bad + other, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000, 0, 0), (5, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ngram_lm.classify(clashing(df, "kept", "perplexity"), labels).collect()}
    assert len(got) == 214 and sum(got[i]["kept"] for i in range(200)) >= 198
    assert not any(got[1000 + i]["kept"] for i in range(10))
    assert got[2000]["kept"] and got[2000]["perplexity"] is None and not got[2001]["kept"] and not got[2002]["kept"]
    assert ngram_lm.classify(nothing, labels).count() == 0
    assert ngram_lm.classify(docs, labels.where("false")).where("kept").count() == docs.where("length(text) > 0").count()


def test_thresholds_are_quantiles(spark):
    import random

    r = random.Random(5)
    words = "the rain in spain stays mainly plain said number of them all wind over sea and hills".split()
    good = [(i, " ".join(r.choice(words) for _ in range(40)), "en") for i in range(400)]
    junk = [(1000, "Xq Xq Xq", "en"), (1001, "Zj Zj Zj Zj Zj", "en"), (1002, "#|| 88", "en")]
    alone = [(3000, good[0][1], "xx"), (3001, "Kq#% Wv|| 77 ZZ", "xx")]
    df = spark.createDataFrame(good + junk + alone, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(400), 3000]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ngram_lm.classify(df, labels, 0.95).collect()}
    held = {x["doc_id"] for x in df.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ngram_lm.HELD_OUT)) == 0).collect()}
    unseen = [got[i] for i in range(400) if i in held]
    assert 3000 not in held and 0.02 <= sum(not x["kept"] for x in unseen) / len(unseen) <= 0.06
    assert not any(got[i]["kept"] for i in (1000, 1001, 1002))
    assert got[3001]["threshold"] == pytest.approx(got[0]["threshold"]) and not got[3001]["kept"]


def test_words_out_of_place_are_rejected(spark):
    import random

    r = random.Random(7)
    # Three bytes before a noun are the same in both phrases: only whole words tell that the nouns are swapped.
    good = [(i, " ".join(r.choice(["golden valley", "wooden harbour"]) for _ in range(20)), "en") for i in range(200)]
    kanji = [(2000 + i, "今日は良い天気です" * (1 + i % 3), "ja") for i in range(200)]
    odd = [(1000, "golden harbour wooden valley " * 10, "en"), (3000, "天で良すは気い日今" * 2, "ja")]
    df = spark.createDataFrame(good + kanji + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good + kanji], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ngram_lm.classify(df, labels).collect()}
    assert not got[1000]["kept"] and not got[3000]["kept"]
    assert sum(got[r[0]]["kept"] for r in good + kanji) >= 390
    assert got[1000]["perplexity"] > 1.08 * max(got[x[0]]["perplexity"] for x in good)


def kneser_ney(texts, trained):
    """Perplexity by word of each text, from counts in dictionaries."""
    import math

    read = [re.findall(SPACED, lower(t)) for t in texts]
    count = Counter(w for i in trained for w in read[i])
    read = [["<edge>", *(w if count[w] > 1 else "<unknown>" for w in t), "<edge>"] for t in read]
    pairs = Counter(p for i in trained for p in zip(read[i], read[i][1:], strict=False))
    firsts, after, k = Counter(), defaultdict(list), Counter()
    for (v, w), c in pairs.items():
        firsts[v] += c
        after[v].append(c)
        k[w] += 1
    unknown = math.log(sum(c for (_, w), c in pairs.items() if w == "<unknown>") + 1)

    def discounts(values):
        n = Counter(values)
        if not n[1] or not n[2]:
            return [0, 0.5, 0.75, 0.75]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1]
        return [min(max(x, low), high) for x, low, high in zip(d, (0, 0.01, 0.01, 0.01), (0, 1, 2, 3), strict=True)]

    d2, d1 = discounts(pairs.values()), discounts(k.values())
    rest = sum(d1[min(x, 3)] for x in k.values()) / len(pairs) / (len(k) + 1)
    out = []
    for t in read:
        total = 0.0
        for v, w in zip(t, t[1:], strict=False):
            p = (k[w] - d1[min(k[w], 3)]) / len(pairs) + rest
            if firsts[v]:
                p = p * sum(d2[min(c, 3)] for c in after[v]) / firsts[v]
                p += (pairs[v, w] - d2[min(pairs[v, w], 3)]) / firsts[v] if pairs[v, w] else 0
            total -= math.log(p) - unknown * (w == "<unknown>")
        out.append(math.exp(total / (len(t) - 1)))
    return out


@pytest.mark.parametrize("hot,flush,slot", [(1 << 20, 1 << 20, 4 << 30), (4, 300, 1000)])
def test_perplexity(spark, monkeypatch, hot, flush, slot):
    """All terms hot, or nearly all asked of shards, over several chunks and slots."""
    import random

    monkeypatch.setattr(ngram_lm, "HOT", {"pair": hot, "first": hot, "word": hot})
    monkeypatch.setattr(ngram_lm, "FLUSH", flush)
    monkeypatch.setattr(ngram_lm, "SLOT", slot)
    r = random.Random(9)
    lists = {x: [x + "".join(r.choice("abcdé") for _ in range(3)) for _ in range(60)] for x in ("en", "de")}
    data = []
    for i in range(240):
        lang = r.choice(["en", "de"])
        data.append((i, " ".join(r.choice(lists[lang][: r.choice([5, 60])]) for _ in range(r.randint(0, 60))).upper() + (" rare%d" % i) * (i % 3), lang))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    held = {x["doc_id"] for x in df.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ngram_lm.HELD_OUT)) == 0).collect()}
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["perplexity"] for x in ngram_lm.classify(df, labels).collect()}
    for lang in lists:
        own = [i for i, t, x in data if x == lang and t]
        # A word is known if all languages together have it twice.
        trained = [j for j, i in enumerate(own) if i < 150 and i not in held]
        want = kneser_ney([data[i][1] for i in own], trained)
        assert [got[i] for i in own] == pytest.approx(want, rel=1e-4)
    assert all(got[i] is None for i, t, _ in data if not t)


# 4 ---------------------------------------------------------------------------------------------


def test_chat(spark):
    data = [(1, 0, "user", "hi <|im_end|> \\ <\\| there"), (1, 1, "assistant", "a\nb<|"), (1, 1, "assistant", "a\nb<|"), (2, 5, None, None), (2, None, "role\nx\\", ""), (None, 0, "assistant", "é日")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(clashing(df, "formatted"))).collect()}
    by = defaultdict(list)
    for c, t, r, x in data:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["n_turns"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(turns))
    assert chat.digests(chat.format_turns(df.where("false"))).count() == 0
    for text in ("\\", "<|", "<\\|", "\\<|\n", "<<||", "\\n"):
        assert chat.unescape(chat.escape(text)) == text and chat.unescape_role(chat.escape_role(text)) == text and "<|" not in chat.escape(text)


def test_chat_parts(spark):
    part = lambda kind, **x: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    content = [part("text", text="look <|"), part("image", ref="i.png", width=56, height=29), part("audio", ref="a.wav", seconds=1.5), part("document", ref="d.pdf", pages=3), part("text", text="end"), None]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.ArrayType(chat.PART))])
    df = spark.createDataFrame([(1, 0, "assistant", content), (1, 1, "user", None)], schema)
    first, second = chat.format_turns(df, "content").orderBy("turn").collect()
    assert first["formatted"] == "<|im_start|>assistant\nlook <\\|<|image_1|><|audio_2|><|document_3|>end<|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 1536)]
    assert all(first["formatted"][a["at"] :].startswith(f"<|{a['kind']}_") for a in first["attachments"]) and first["expanded_tokens"] == 4 + 38 + 1536
    lengths = [float("nan"), float("inf"), -5.0, 1e300]
    odd = chat.format_turns(spark.createDataFrame([(1, i, "user", [part("audio", seconds=x)]) for i, x in enumerate(lengths)], schema), "content").orderBy("turn").collect()
    assert [x["expanded_tokens"] for x in odd] == [1, 1, 1, 25 * 10**12]
    whole = chat.digests(chat.format_turns(df, "content")).first()
    assert (whole["n_attachments"], whole["expanded_tokens"]) == (3, 4 + 38 + 1536)
    assert first["formatted"][first["loss_start"] : first["loss_end"]].endswith("end") and second["loss_start"] == second["loss_end"]


# 5 ---------------------------------------------------------------------------------------------


def test_topk(spark):
    import math
    import random

    r = random.Random(5)
    vectors = [(i, [r.gauss(0, 1) for _ in range(24)]) for i in range(300)] + [(400, [0.5] * 24), (401, [0.5] * 24), (500, None), (501, [1.0, None]), (502, [float("nan")] * 24), (503, []), (600, [1.0, 2.0]), (601, [1.0, 2.0]), (700, [float("inf")] * 24), (None, [1.0] * 24), (100, [9.0] * 24)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    got = defaultdict(list)
    for x in topk.search(topk.integers(clashing(df, "score", "rank")), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    import numpy as np

    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in whole:
        if q % 100 == 0 and q != 100:
            scored = sorted(((sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v)), key=lambda s: (-s[0], s[1]))[:10]
            assert got[q] == [(i, s) for s, i in scored], q
    assert len(got[100]) == 20 and len(got[600]) == 1
    assert topk.search(topk.integers(df.where("false")), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_of_large_components(spark, monkeypatch):
    """Scores in 64 bits, beyond them, and bounds that doubles can't hold; in several chunks."""
    import math
    import random

    r = random.Random(8)
    scale = [1.0, 16384.0, 1e6, 1e12, 1e200]
    vectors = [(i, [r.gauss(0, 1) * scale[i % 5 if i < 200 else 0] for _ in range(6)]) for i in range(400)] + [(1000, [1.0, 2.0]), (1001, [20000.0, 1.0]), (1002, [3.0, 1.0]), (1003, [1.7e308, -1.7e308])]
    monkeypatch.setattr(topk, "BLOCK", 32)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for x in topk.search(topk.integers(df), F.col("vec_id") % 100 == 0, chunk_mb=1).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    whole = [(i, [int(max(-1.7976931348623157e308, min(1.7976931348623157e308, 1024 * x))) if math.isinf(1024 * x) else math.floor(1024 * x) for x in v]) for i, v in vectors]
    for q, v in whole:
        if q % 100 == 0:
            scored = sorted(((max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in whole if i != q and len(w) == len(v)), key=lambda s: (-s[0], s[1]))[:10]
            assert got[q] == [(i, s) for s, i in scored], q
    assert got[1000][0] == (1003, topk.MOST) or got[1000][0][0] == 1001


# 6 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length", [24, 400])
def test_suffix_dedup(docs, rows, nothing, length):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    want = Counter()
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        want[repr((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))] += 1
    got = suffix_dedup.dedup(clashing(docs, "n_bytes", "kept"), length, keep_bytes=True).collect()
    assert Counter(repr(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))) for r in got) == want
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix_dedup.dedup(nothing).count() == 0


# 7 ---------------------------------------------------------------------------------------------


def shingles(t):
    w = re.findall(SPACED, lower(t))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def test_jaccard_join(docs, rows, nothing):
    low = -(1 << 63)
    sets = [(low if d is None else d, shingles(t)) for d, t, *_ in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 4 * len(x & y) >= 3 * len(x | y)]
    of = groups([d for d, _ in sets], links)
    want = Counter((None if d == low else d, len(s), None if (of[d] if s else d) == low else (of[d] if s else d)) for d, s in sets)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(clashing(docs, "n", "id", "component_id")).collect())
    assert got == want and jaccard_join.join(nothing).count() == 0


def test_jaccard_join_of_a_large_group(spark):
    """Near copies of one text, in chains: some are similar to the middle only, some to outer ones only."""
    import random

    r = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(400):
        w = list(base)
        for k in range(r.randint(0, 6)):
            w[r.randrange(80)] = f"x{i}_{k}"
        data.append((i, " ".join(w)))
    data += [(1000 + i, " ".join([f"y{i}_{k}" for k in range(60)] + base[:50])) for i in range(100)]
    sets = {d: shingles(t) for d, t in data}
    ids = list(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    of = groups(ids, links)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.join(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()}
    assert got == of and len(set(of.values())) > 100


def test_components(spark):
    import random

    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(r.randrange(500, 900), r.randrange(500, 900)) for _ in range(150)] + [(7, 7)]
    of = groups({n for x in links for n in x}, links)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in of.items() if n != 7 or n in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8 ---------------------------------------------------------------------------------------------


def test_line_rules(docs, rows, nothing):
    want = Counter()
    for d, t, *_ in rows:
        t = t or ""
        w = re.findall(SPACED, t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(SPACED, line):
                again += line in seen
                seen.add(line)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        want[repr((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))] += 1
    got = line_crf.judge(clashing(docs, "kept", "n_words"), line_crf.Chain()).collect()
    assert Counter(repr(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got) and line_crf.judge(nothing, line_crf.Chain()).count() == 0


def test_viterbi_is_the_best_sequence():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    chain = line_crf.Chain(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    doc = np.repeat(np.arange(6), [1, 4, 2, 7, 3, 5])
    x = rng.normal(size=(len(doc), 3))
    label = chain.viterbi(x, doc)
    for d in range(6):
        own = np.flatnonzero(doc == d)
        score = lambda y, own=own: chain.first[y[0]] + sum((x[i] @ chain.weights) * z for i, z in zip(own, y, strict=True)) + sum(chain.follow[a, b] for a, b in zip(y, y[1:], strict=False))
        assert tuple(label[own]) == max(itertools.product((0, 1), repeat=len(own)), key=score)


def test_field_learns(spark):
    good = [(i, "A quiet line of text about something.\nAnother one follows it here today.\n" * 3) for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!! | $$$ | ### | CLICK!!\n" * 6) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 100), 0) for d, _ in good[:40] + bad[:40]], "doc_id long, quality int, toxic int")
    chain = line_crf.train(df, labels)
    got = {r["doc_id"]: r["content_share"] for r in line_crf.judge(df, chain).collect()}
    assert all(got[i] > 0.9 for i in range(40, 60)) and all(got[100 + i] < 0.1 for i in range(40, 60))
    assert line_crf.train(df, labels.where("false")).weights.tolist() == list(line_crf.PRIOR)


# 9 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("num,den", [(4, 5), (1, 2)])
def test_line_dedup(spark, docs, rows, nothing, num, den):
    keys = {(r["doc_id"], r["text"]): (-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["h"]) for r in docs.withColumn("h", F.xxhash64("text")).collect()}
    lines = sorted({(*keys[d, t], k, frozenset(re.findall(SPACED, lower(x)))) for d, t, *_ in rows for k, x in enumerate((t or "").split("\n")) if re.search(SPACED, x)}, key=lambda x: x[:3])
    first = {}
    for *at, s in lines:
        first.setdefault(s, tuple(at))
    order = sorted(first, key=first.get)
    kept = {first[s] for i, s in enumerate(order) if not any(den * len(s & u) >= num * len(s | u) for u in order[:i])}
    want = Counter()
    for d, t, *_ in rows:
        parts = [] if t is None else t.split("\n")
        full = [bool(re.search(SPACED, x)) for x in parts]
        stays = [(*keys[d, t], k) in kept for k in range(len(parts))]
        gone = sum(full) - sum(s and f for s, f in zip(stays, full, strict=True))
        out = t if not gone else "" if gone == sum(full) else "\n".join(x for x, f, s in zip(parts, full, stays, strict=True) if s or not f)
        want[repr((d, out, sum(full), gone))] += 1
    got = line_dedup.dedup(clashing(docs, "n_lines", "n_removed"), num, den).collect()
    assert Counter(repr((r["doc_id"], r["text"], r["n_lines"], r["n_removed"])) for r in got) == want
    assert line_dedup.dedup(nothing).count() == 0


def near_lines(n, seed=4):
    """Lines of 40 words, of which up to 5 are changed: similar to the first, to some others, or to none."""
    import random

    r = random.Random(seed)
    base = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        w = list(base)
        for k in range(r.randint(0, 5)):
            w[r.randrange(40)] = f"x{i % 40}_{k}" if r.random() < 0.5 else f"y{i}_{k}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("window", [2048, 100])
def test_line_dedup_of_a_large_group(spark, monkeypatch, window):
    """Dense lists, found pair by pair or looked through for first ones, and what these leave open."""
    from metricloom.llm import set_join

    monkeypatch.setattr(set_join, "WINDOW", window)
    monkeypatch.setattr(set_join, "X_BLOCK", 16)
    monkeypatch.setattr(set_join, "Z_BLOCK", 64)
    lines = near_lines(400)
    data = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(100)]
    kept, seen = defaultdict(list), []
    for i, line in enumerate(lines):
        s = frozenset(line.split())
        if not any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
            kept[i // 4].append(line)
        if s not in seen:
            seen.append(s)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: "\n".join(kept[i]) for i in range(100)} and 5 < sum(map(len, kept.values())) < 200


def test_pairs_grow_with_a_group(spark):
    """Twice the lines of a group of near copies give about twice the pairs to verify, not four times."""
    from metricloom.llm import set_join
    from metricloom.llm.frequency import Survey

    made = []
    for n in (500, 1000, 2000):
        x = line_dedup.LineSets.read(*textscan.buffer_of(pa.array(["\n".join(near_lines(n))])))
        import numpy as np

        known = Survey(8, np.full(32, 255, np.uint8), np.zeros(0, np.uint32), np.zeros(0, np.int32))
        pairs, entries = set_join.first_candidates(set_join.postings(x.of, x.word, x.n, x.id, np.arange(len(x.n)), known, 4, 5, 2), 4, 5)
        made.append(len(pairs))
        assert entries.num_rows
    assert made[1] < 3 * made[0] and made[2] < 3 * made[1] and made[2] < 40 * 2000


def rows_made(spark, node, last):
    """The most rows that a node whose description begins so gave, of the executions after `last` (-1: there is none)."""
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), -1
    for n in range(last, store.executionsCount()):
        key = store.executionsList().apply(n).executionId()
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for own in (nodes.apply(k) for k in range(nodes.size())):
            if own.desc().startswith(node):
                metrics = {m.name(): m.accumulatorId() for m in (own.metrics().apply(k) for k in range(own.metrics().size()))}
                most = max(most, int(values.apply(metrics["number of output rows"]).replace(",", "")))
    return most


def test_blocks_of_a_group_give_few_rows(spark):
    """Lines that no first one removes meet all others, in each list that they share; only removed ones come out."""
    lines = near_lines(400)
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)).collect()
    sets = [frozenset(x.split()) for x in lines]
    lost = {i for i, s in enumerate(sets) if any(5 * len(s & t) >= 4 * len(s | t) for t in sets[:i])}
    assert {x["doc_id"] for x in got if x["n_removed"]} == lost and 300 < len(lost) < 390
    assert 0 < rows_made(spark, "FlatMapGroupsInArrow [word", before) < len(lines)


def test_pairs_grow_with_a_group_that_comes_late(spark, monkeypatch):
    """The first lines of a list are like no other; those after them are near copies of one another."""
    from metricloom.llm import set_join
    from metricloom.llm.frequency import Survey

    monkeypatch.setattr(set_join, "WINDOW", 100)
    monkeypatch.setattr(set_join, "FIRSTS", 32)
    import numpy as np

    known, made = Survey(8, np.full(32, 255, np.uint8), np.zeros(0, np.uint32), np.zeros(0, np.int32)), []
    for n in (500, 1000, 2000):
        alone = [" ".join([f"w{k}" for k in range(40) if (i + k) % 4] + [f"a{i}_{k}" for k in range(10)]) for i in range(200)]
        x = line_dedup.LineSets.read(*textscan.buffer_of(pa.array(["\n".join(alone + near_lines(n))])))
        pairs, entries = set_join.first_candidates(set_join.postings(x.of, x.word, x.n, x.id, np.arange(len(x.n)), known, 4, 5, 2), 4, 5)
        made.append(len(pairs))
    assert made[1] < 3 * made[0] and made[2] < 3 * made[1] and made[2] < 40 * 2000


# 10 --------------------------------------------------------------------------------------------


def test_pieces_round_trip(docs, rows, nothing):
    got = pieces.decode(pieces.sample(clashing(docs, "ids", "sample"), k=3)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert {(d, t or "") for d, t, *_ in rows} == {(r["doc_id"], r["text"]) for r in got}
    for d, t, *_ in rows:
        own = [r for r in by[d] if r["text"] == (t or "")]
        same = sum((a, b) == (d, t) for a, b, *_ in rows)
        assert len({tuple(r["ids"]) for r in own}) * same == len(own) <= 3 * same
        ranked = sorted(own, key=lambda r: r["sample"])
        assert all(a["score"] >= b["score"] for a, b in zip(ranked, ranked[1:], strict=False)) and all(0 <= r["inclusion"] <= 1 and r["n_pieces"] == len(r["ids"]) and r["round_trip"] for r in own)
    encoded = pieces.decode(pieces.encode(docs).drop("text")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in encoded) == Counter((d, t or "") for d, t, *_ in rows)
    assert pieces.sample(nothing).count() == 0


def test_own_segmentation_is_a_path(spark, rows):
    v = pieces.Vocabulary.load()

    def is_path(t, ids):
        x = pieces.Texts([t], pieces.row_keys(pa.array([0]), 1), v)
        for node in x.node:
            while not x.lattice.last[node]:
                for e in range(x.lattice.begin[node], x.lattice.stop[node]):
                    piece = int(x.lattice.piece[e])
                    own = [piece] if piece >= 0 else v.byte_id[list(chr(x.lattice.point[node]).encode())].tolist()
                    if ids[: len(own)] == own:
                        ids, node = ids[len(own) :], x.lattice.to[e]
                        break
                else:
                    return False
        return not ids

    texts = ["a 1 b", "1", " 17", "x  y", "x   2", "\n  1 \n \n", "end ", "end  ", " " * 40 + "z", " ", "  ", "a ▁ 1", "日本  語 9"] + [t for _, t, *_ in rows if t]
    for r in pieces.encode(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert is_path(r["text"], r["ids"]), r["text"]


def test_pieces_follow_their_distribution():
    import numpy as np

    v = pieces.Vocabulary.load(offset=1000.0)
    whole = list(pieces.Texts(["the"], pieces.row_keys(pa.array([0]), 1), v).sample(50))
    p = {}
    for d, log_prob, _, _, path in whole:
        p[tuple(pieces.Texts(["the"], pieces.row_keys(pa.array([0]), 1), v).ids(path)[0].tolist())] = float(np.exp(log_prob[0]))
        assert len(d) == 1
    assert sum(p.values()) == pytest.approx(1)
    n = 20000
    x = pieces.Texts(["the"] * n, pieces.row_keys(pa.array(range(n)), 1), v)
    weight, seen = 0.0, [Counter(), Counter()]
    for nth, (d, log_prob, _, inclusion, path) in enumerate(x.sample(2)):
        ids, size = x.ids(path)
        at = np.concatenate([[0], np.cumsum(size)])
        for i in d:
            seen[nth][tuple(ids[at[i] : at[i + 1]].tolist())] += 1
        weight += float((np.exp(log_prob) / inclusion).sum())
    for s, q in p.items():
        second = sum(p[a] * q / (1 - p[a]) for a in p if a != s)
        assert seen[0][s] / n == pytest.approx(q, abs=0.015) and seen[1][s] / n == pytest.approx(second, abs=0.015)
    assert weight / n == pytest.approx(1, abs=0.02)


def test_samples_do_not_depend_on_batches(docs):
    key = lambda df: sorted(repr(r) for r in df.collect())
    assert key(pieces.sample(docs)) == key(pieces.sample(docs.repartition(9)))


# Text scanning and the pipeline ------------------------------------------------------------------


def test_words_and_shingles(rows):
    texts = [t for _, t, *_ in rows]
    data, at = textscan.buffer_of(pa.array(texts))
    words = textscan.Words(textscan.LOWER[data], at, textscan.NON_SPACE)
    assert words.count.tolist() == [len(re.findall(SPACED, t or "")) for t in texts]
    doc, _ = textscan.shingles(words)
    assert Counter(doc.tolist()) == Counter({i: len(shingles(t)) for i, t in enumerate(texts) if shingles(t)})
    flat = [w for t in texts for w in re.findall(SPACED, lower(t))]
    assert len(set(words.hash.tolist())) == len(set(flat)) and len({(h, w) for h, w in zip(words.hash.tolist(), flat, strict=True)}) == len(set(flat))


def test_one_document_of_each_group_stays(spark, docs, rows, nothing, tmp_path):
    """Repeated ids, ids that are null, repeated rows: each row is a document."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    apart = list(dict.fromkeys(rows))
    sets = [shingles(r[1]) for r in apart]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    of = groups(range(len(sets)), links)
    want = {}
    for i in sorted(range(len(apart)), key=lambda i: (apart[i][0] is None, apart[i][0] or 0)):
        want.setdefault(of[i], apart[i][0])
    assert Counter(r["doc_id"] for r in got) == Counter(want.values()) and len(got) < len(apart)
    unique = docs.where("doc_id > 17 and doc_id <> 21")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, unique, str(tmp_path)).collect()}
    assert kept == {r["doc_id"] for r in jaccard_join.join(unique).where("doc_id = component_id").collect()}
    assert corpus_pipeline.near_duplicates(spark, nothing, str(tmp_path)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.createDataFrame([(100 + 2 * i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert now.columns == corpus_pipeline.COLUMNS
            assert now.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, now.collect()))
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
