"""The training-data operators: SQL, brute force, round trips, held-out accuracy and the odd tables."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import check, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsake.llm import labels as labels_of
from keepsake.llm import components, decontaminate, exact_dedup, licences, mph, ngram_join, packing, pii, quality, queries, shingles, token_files, tokens, toxicity, url_filter

FOLDER = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, score double, digest string, n int"
ODD = [(1, None, "a", 0.5, "x", 1), (2, "", "a", 0.5, "x", 1), (3, " \n\t ", None, None, None, None), (None, "some words that say a little more", "b", 1.0, "y", 2), (5, "same text here twice over", "b", 1.0, "y", 2), (5, "same text here twice over", "b", 1.0, "y", 2), (6, "long " * 30000, "c", 0.0, "z", 3), (7, "\x1c odd \x00 blanks\x85 and  doubles \n\n here", "c", 0.0, "z", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows, and columns whose names operators use."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    check(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLES[name])


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 2**63, (n, 2)).astype(np.uint64), axis=0)
        find = mph.Lookup(mph.build(keys))
        assert sorted(find(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        mph.build(np.zeros((2, 2), np.uint64))


# 1: benchmark decontamination


def brute_contained(rows, items):
    words = lambda t: [w for w in re.split("[\\x20\\x09-\\x0D]+", (t or "").lower()) if w]
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, q in items:
        w = words(q)
        own = runs(w, min(5, len(w))) if w else set()
        out |= {(d, i) for d, t in rows if own and 100 * len(own & runs(words(t), min(5, len(w)))) >= 80 * len(own)}
    return out


def test_decontaminate_odd(spark, odd, empty):
    items = [(1, "long long long long long long long"), (2, "that say"), (3, None), (4, ""), (None, "some words that say a little more"), (1, "long long long long long long long"), (5, " \n "), (6, "Twice"), (7, "say a lot"), (8, "same text here twice over"), (9, "same text here twice")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(odd, table).collect()}
    assert got == brute_contained([r[:2] for r in ODD], items) == {(6, 1), (None, None), (None, 2), (5, 6), (5, 8), (5, 9)}
    assert decontaminate.contained(empty, table).count() == 0
    assert decontaminate.contained(odd, table.where("false")).count() == 0


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, 0])
def test_decontaminate_finds_edited_items(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    rng = random.Random(0)
    words = [f"w{i}" for i in range(500)]
    passage = rng.choices(words, k=12)  # items share it
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 6, 12, 30, 60, 90])) + (passage if i % 3 == 0 else []))) for i in range(40)]
    rows = []
    for _, t in items:
        w = t.split()
        for d in range(4):
            v = list(w)
            for _ in range(d):
                v[rng.randrange(len(v))] = "edit"
            rows.append((len(rows), " ".join(rng.choices(words, k=100) + v + rng.choices(words, k=50) + (passage if d == 1 else []))))
    want = brute_contained(rows, items)
    got = decontaminate.contained(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 60


# 2: URL filter


def test_url_rules(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x", "https://example.net/fr/", "http://x.net", "http://x.net/", "http://b.org/fr/a?x", "http://b.org/de/", "http://example.com/de/q#f", "http://c.io/free-casino", "http://c.io/freedom", "http://c.io/free", "http://c.io/free/bet", "http://c.io/free/free"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    want = [("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/fr/", "net/", "block"), ("x.net", "", None, "allow"), ("x.net", "/", "net/", "block"), ("b.org", "/fr/a", "org/fr/", "allow"), ("b.org", "/de/", None, "allow"), ("example.com", "/de/q", "example.com/de/", "block")]
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(9)] == want
    assert [got[i].verdict for i in range(9, 14)] == ["block", "allow", "allow", "block", "allow"]


# 3 and 8: classifiers


@pytest.mark.parametrize("name,label", [("op3_quality", "quality"), ("op8_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    got = queries.QUERIES[name](spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    assert (got["predicted"] == got[label]).mean() > 0.9


def test_classifiers_odd(spark, odd, empty, labels):
    none = labels.where("false")
    for fit, score in ((quality.fit, lambda d, m: quality.score(d.drop("score"), m)), (toxicity.fit, toxicity.score)):
        for d in (odd, empty):
            for l in (labels, none):
                rows = score(d, fit(d, l)).collect()
                assert len(rows) == d.count() and all(0 <= r.score <= 1 for r in rows)


def test_quality_is_its_rules(spark, docs, labels):
    """Every score against statistics and rules evaluated in Python."""
    model = quality.fit(docs, labels)

    def statistics(t):
        t = t or ""
        words, lines = re.split(r"[ \t\n\x0b\f\r]+", t), t.split("\n")
        n, chars = len(words), max(len(t), 1)
        count = lambda f: sum(map(f, t)) / chars
        kind = lambda c: unicodedata.category(c)
        blank = " \t\n\x0b\f\r"
        return {
            "chars": len(t), "word_length": chars / n, "upper": count(lambda c: kind(c) == "Lu"), "signs": count(lambda c: not (kind(c)[0] in "LN" or c in blank + ".,")),
            "digits": count(lambda c: c in "0123456789"), "marks": len(re.findall(r"[*#$%&!]{2}", t)) / n, "bars": t.count("|") / n, "stops": len(re.findall(r"[.?!](?=[ \t\n\x0b\f\r]|$)", t)) / n,
            "twice": len(re.findall(r"(?<![^ \t\n\x0b\f\r])([^ \t\n\x0b\f\r]+) (?=\1(?:[ \t\n\x0b\f\r]|$))", t)) / n, "distinct_words": len(set(words)) / n, "distinct_lines": len(set(lines)) / len(lines), "line_words": n / len(lines),
        }

    text = dict(docs.select("doc_id", "text").collect())
    worst = []
    for r in quality.score(docs, model).select("doc_id", "score").collect():
        x = statistics(text[r.doc_id])
        total = model.intercept + sum(w.weight for w in model.rules if all(x[name] > cut if above else x[name] <= cut for name, above, cut in w.terms))
        worst.append(abs(r.score - 1 / (1 + np.exp(-total))))
    assert sum(w > 1e-9 for w in worst) <= 0.01 * len(worst), sorted(worst)[-5:]  # a cut may fall on a rounding


def test_quality_keeps_all_without_labels(spark, odd, labels):
    names = odd.withColumnsRenamed({"score": "statistics", "n": "score_"}).withColumn("Score", F.lit(1))
    kept = quality.keep(names, quality.fit(names, labels.where("false")))
    assert kept.columns == names.columns and kept.count() == len(ODD)
    assert quality.keep(names, quality.fit(names, labels)).columns == names.columns
    assert quality.score(names, quality.fit(names, labels), name="new").columns == [*names.columns, "new"]


def test_labelled_rows_are_bounded(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    assert not zlib.crc32(b"1") % 4 == 2  # the hot id may be learned from
    for most in (1, 700):
        got = [tuple(r) for r in labels_of.labelled(docs, marks, "toxic", most).select("doc_id", "text", "y").collect()]
        assert len(got) == most and sorted(got) == sorted(tuple(r) for r in labels_of.labelled(docs.repartition(5), marks, "toxic", most).select("doc_id", "text", "y").collect())


def test_toxicity_is_its_gains(spark, docs, labels):
    """Every score against compressed lengths taken window by window, without tables."""
    model = toxicity.fit(docs, labels)
    make = lambda: (toxicity.Gains._compressor(model.dictionaries.toxic), toxicity.Gains._compressor(model.dictionaries.ordinary))
    toxic, ordinary = make()
    text = dict(docs.select("doc_id", "text").collect())
    for r in toxicity.score(docs, model).collect():
        gains = []
        for run in (text[r.doc_id] or "").split():
            windows = [toxicity.staircase(k) for k in toxicity.windows(run)]
            gains += [(len(ordinary.compress(w)) - len(toxic.compress(w))) / len(w) for w in windows] or [0.0]
        high = sorted((g for g in gains if g > 0.1), reverse=True)
        x = [high[0], sum(high[:3]) / 3, sum(g - 0.1 for g in high) / len(gains), sum(g - 0.2 for g in high if g > 0.2) / len(gains) ** 0.5, sum(g > 0.3 for g in high) / len(gains)] if high else [0.0] * 5
        assert abs(r.score - 1 / (1 + np.exp(-(np.dot(x, model.weights) + model.intercept)))) < 1e-9


def test_toxicity_reads_whole_runs():
    mild = [f"the {w} day was calm and {w} again" for w in ("quiet", "sunny", "plain", "early", "late")] * 4
    model = toxicity.train(mild + [f"you {w} idiot go" for w in ("silly", "daft", "odd", "dull", "rude")] * 4, np.array([0] * 20 + [1] * 20))
    gains = toxicity.Gains(model)
    top = gains.features("idiot")[0]
    assert top > 0.3
    for text in ("wonderful,you-worthless-idiot", "read/this/idiot", "wonderfulweatheridiot", "x" * 200 + "idiot", "calm1idiot2calm"):
        assert gains.features(text)[0] > 0.3, text
    assert gains.features("wonderful,calm-weather")[0] <= 0.1
    word = "abcdefghijklmnopqrstuvwxyz"
    for learn in (False, True):
        assert "".join(sorted(set("".join(toxicity.windows(word, learn))))) == word


def test_quality_rules_separate():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    m = quality.train(x, y, ["a", "b", "c"])
    total = m.intercept + sum(r.weight * quality._holds(r.terms, x, {"a": 0, "b": 1, "c": 2}) for r in m.rules)
    assert ((total > 0) == y).mean() > 0.98 and m.rules


# 4: PII


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        total = sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return True


def base(text):
    return sorted(((m.start(), m.end(), k) for k in PATTERNS for m in re.finditer(PATTERNS[k], text) if valid(k, m[0])), key=lambda s: (s[0], pii.RANK[s[2]]))


def test_pii_is_a_pattern_search(spark, docs):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123459.@+- (a)é%") for _ in range(rng.randint(0, 60))) for _ in range(20000)]
    for t in texts:
        assert [s for s in pii.spans(t) if s[2] in pii.BASE] == base(t)
    text = dict(docs.select("doc_id", "text").collect())
    for r in queries.QUERIES["op4_pii"](spark, FOLDER).collect():
        found = base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(found).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(Counter(k for _, _, k in found)[k] for k in pii.BASE)


def test_pii_added_kinds_and_odd(odd, empty):
    kinds = [k for _, _, k in pii.spans("IBAN: GB82 WEST 1234 5698 7654 32, IBAN GB00 WEST 1234 5698 7654 32, ssn 123-45-6789, https://bob:s3cret@h.example/x, lesson 123-45-6789")]
    assert kinds == ["iban", "ssn", "login", "email"]
    assert pii.find(odd).count() == len(ODD) and pii.find(empty).count() == 0
    assert pii.spans(None) == [] == pii.spans("")


# 5: licences


def test_licences(spark, odd, empty):
    model = licences.fit(odd)
    lines = [t for ts in licences.TEMPLATES.values() for t in ts]
    rows = [(i, f"first line\n{t}\nlast line") for i, t in enumerate(lines)] + [(100 + i, p) for i, p in enumerate(licences.PHRASES)]
    got = {r.doc_id: {p.family for p in r.paragraphs if p.confirmed} for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    want = [{f} for f, ts in licences.TEMPLATES.items() for _ in ts]
    assert [got[i] for i in range(len(lines))] == want
    assert not any(got[100 + i] for i in range(len(licences.PHRASES)))
    assert licences.scan(odd, model).count() == len(ODD) and licences.scan(empty, licences.fit(empty)).count() == 0


def test_licences_wrapped_and_several(spark, odd):
    rows = [(1, "one\n\ntwo\nLicensed under the Apache\nLicense, Version 2.0\nlast"), (2, "Apache License, Version 2.0 or the MIT License"), (3, "Licensed under the Apache\n\nLicense, Version 2.0"), (4, "\n".join("Released under the MIT License".split()))]
    got = {r.doc_id: sorted((p.family, p.line) for p in r.paragraphs if p.confirmed) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.fit(odd)).collect()}
    assert {f for f, _ in got[1]} == {"apache"} and got[1][0][1] == 1
    assert [f for f, _ in got[2]] == ["apache", "mit"]
    assert got[3] == []
    assert [f for f, _ in got[4]] == ["mit"]


def test_licences_in_documents(spark, docs):
    got = {r.doc_id: r.families.split(",") for r in queries.QUERIES["op5_licences"](spark, FOLDER).collect()}
    for d, t in docs.select("doc_id", "text").collect():
        for family, line in (("apache", "Licensed under the Apache License, Version 2.0."), ("mit", "Released under the MIT License."), ("cc", "Licensed under CC BY-NC 4.0.")):
            assert (family in got[d]) == (line in t)


# 6: exact dedup


def test_dedup_odd(odd, empty):
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.dedup(odd).collect())
    assert got == sorted([("1", "2", 2, False), ("2", "2", 2, True), ("3", "3", 1, True), ("None", "None", 1, True), ("5", "5", 2, True), ("5", "5", 2, False), ("6", "6", 1, True), ("7", "7", 1, True)])
    assert exact_dedup.dedup(empty).count() == 0


def test_dedup_history(spark):
    seen = spark.createDataFrame([(9, "a"), (8, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c"), (20, "b")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept, r.in_history) for r in exact_dedup.dedup(new, exact_dedup.history_of(seen)).collect()}
    assert got == {1: (9, False, True), 2: (3, False, False), 3: (3, True, False), 20: (20, True, True)}


def test_dedup_takes_winners_from_the_slots(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i % 5}") for i in range(40)] + [(100, "alone"), (-3, "first")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size, r.in_history) for r in exact_dedup.dedup(docs).collect()}
    want = {i: (35 + i % 5, i >= 35, 8) for i in range(40)} | {100: (100, True, 1), -3: (-3, True, 1)}
    assert {k: v[:3] for k, v in got.items()} == want
    assert {v[3] for v in got.values()} == {True, False}  # members and nonmembers
    lookup = exact_dedup.lookup
    monkeypatch.setattr(exact_dedup, "lookup", lambda *a: lookup(*a).withColumns({"member": F.lit(False), "winner": F.lit(None).cast("long")}))
    assert {r.doc_id: r.keep_id for r in exact_dedup.dedup(docs).collect()} != {k: v[0] for k, v in want.items()}


def test_dedup_large_ids_beside_null_ones(spark):
    big = 2**60
    rows = [(None, "a"), (None, "b"), (big + 1, "a"), (big + 3, "a"), (big + 5, "c"), (big + 7, "c"), (None, "d"), (None, "d"), (big + 9, None), (big + 11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    winners = {"a": big + 3, "b": None, "c": big + 7, "d": None, "": big + 11}
    for history in (None, exact_dedup.history_of(docs), exact_dedup.history_of(docs.where("text = 'd' OR doc_id IS NULL")), exact_dedup.history_of(docs.where("false"))):
        got = exact_dedup.dedup(docs, history, shards=1).collect()
        sha = {hashlib.sha256(t.encode()).hexdigest(): w for t, w in winners.items()}
        assert len(got) == len(rows) and all(r.keep_id == sha[r.text_sha256] for r in got)
        assert sum(r.kept for r in got) == 5


# 7 and 9: tokens


@pytest.mark.parametrize("kind,name", [(tokens.ByteWords, "byte_bpe_50k.json"), (tokens.LowerWords, "word_bpe_49k.json")])
def test_ids_are_the_tokenizers(docs, kind, name):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab É'sß1²\n\t ,.!\x1c\x85\xa0　日́'llStre-") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += [r.text for r in docs.limit(50).collect()] + ["<|endoftext|> a", "a <|startoftext|>", "no<|endoftext|>blank <|endoftext|>", "x" * 100 + " " + "é" * 100]
    encode, own = kind(tokens.public_path(name), 20_000), Tokenizer.from_file(tokens.public_path(name))
    assert 50256 in own.encode(texts[-4], add_special_tokens=False).ids or 49407 in own.encode(texts[-4], add_special_tokens=False).ids
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_new_words_at_once():
    """A null inside a text is no mark of a text's first word, signs come off words where they are a piece apart."""
    texts = ["b c", "a \0b", "a\n\0b", "\0b", "it's. o'clock? 12. x2; \xb2. \xaa! (a) a/. -- --. don't", "caf\xe9. \xdf, \xf7. \u0431. \u65e5.", "a\nb.\nc. b.\nc", ". a", "!\n! a!", "\u0120a \u010ab.", "z" * 70 + ". " + "z" * 70]
    encode, own = tokens.ByteWords(tokens.public_path("byte_bpe_50k.json"), 1000), Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    for t in 3 * texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_a_worker_of_token_files_keeps_two_generations():
    """No more than the words of two generations: an executor has several workers and a heap beside them."""
    rng, size = random.Random(5), 400_000
    encode = tokens.ByteWords(tokens.public_path("byte_bpe_50k.json"), size)
    for _ in range(100):
        encode(" ".join("".join(rng.choices("abcdefghij", k=9)) + rng.choice(["", ".", ","]) for _ in range(100)))
    held = sum(len(w) + len(ids) + tokens.ENTRY for t in (encode, encode.old, encode.parts, encode.old_parts) for w, ids in t.items())
    assert size < held < 2 * size + 10 * tokens.ENTRY
    assert 2 * token_files.TABLE <= 112 << 20


def test_token_files_round_trip(spark, odd, empty, tmp_path):
    path = tokens.public_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    token_files.write(odd, str(tmp_path / "a"), path)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids) for r in token_files.read(spark, str(tmp_path / "a")).collect())
    want, start = [], 0
    for key, text in sorted(((d is not None, d or 0), t or "") for d, t, *_ in ODD):  # rows of one key have one text here
        ids = [*own.encode(text, add_special_tokens=False).ids, 0]
        want.append((key, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    for m in spark.read.parquet(str(tmp_path / "a" / "manifest")).collect():
        shard = token_files.Shard(str(tmp_path / "a"), m.shard, m.width)
        assert shard.get(999) is None
        for key in {None if n else int(k) for k, n, _ in shard.table.tolist()}:
            assert shard.get(key).astype("<u4").tobytes() == b"".join(x[3] for x in want if x[0] == (key is not None, key or 0))
    token_files.write(empty, str(tmp_path / "b"), path)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def test_token_files_spread_a_hot_key(spark, tmp_path):
    path = tokens.public_path("byte_bpe_50k.json")
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.lit("the same words").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(rows, str(tmp_path / "a"), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = spark.read.parquet(str(tmp_path / "a" / "manifest")).collect()
    assert len(shards) > 3 and max(s.docs for s in shards) < 1500 and sum(s.docs for s in shards) == 4000
    got = token_files.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(keys) == 4000
    assert [r.start for r in got] == [i * got[0].n_tokens for i in range(4000)]
    held = [token_files.Shard(str(tmp_path / "a"), s.shard, s.width).get(7) for s in shards]
    assert sum(len(h) for h in held if h is not None) == keys.count(7) * got[0].n_tokens


def test_packing(spark, odd, empty, docs):
    """Pieces, starts, ids and places against the tokenizer and against one naive best fit over all."""
    path = tokens.public_path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    for frame, length in ((odd, 64), (docs.repartition(8), 256)):
        rows, by, pieces = packing.pack(frame, path, length=length).collect(), defaultdict(list), defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids))
        for held in by.values():
            at = 0
            for offset, n in sorted(held):
                assert offset == at
                at += n
            assert at <= length
        want, sizes = defaultdict(list), []
        for k, t in frame.select("doc_id", "text").collect():
            ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
            for i, at in enumerate(range(0, len(ids), length)):
                cut = ids[at : at + length]
                want[k].append((i, at, len(cut), np.array(cut, "<u4").tobytes()))
                sizes.append(len(cut))
        assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
        free = []
        for n in sizes:  # the naive best fit keeps every bin open
            best = min((i for i, f in enumerate(free) if f >= n), key=lambda i: free[i], default=None)
            if best is None:
                free.append(length - n)
            else:
                free[best] -= n
        assert len(by) <= 1.02 * len(free) + 1
    digest = packing.digest(packing.pack(docs, path)).collect()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in digest} == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in packing.pack(docs, path).collect()}
    assert packing.pack(empty, path).count() == 0


def test_packing_hardly_depends_on_tasks(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["a"] * rng.randint(1, 600))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = tokens.public_path("word_bpe_49k.json")
    made = [packing.pack(docs.repartition(n), path).select("sequence_id").distinct().count() for n in (1, 100)]
    least = -(-sum(len(t.split()) + 1 for _, t in rows) // 2048)
    assert made[0] <= 1.01 * least and made[1] <= 1.04 * least, (made, least)  # thirty documents a task: four sequences


def test_packer_fits_best_and_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 3, 4, 7, 5)] == [(0, 0), (0, 6), (1, 0), (2, 0), (1, 4)]
    rng = random.Random(0)
    sizes = [rng.randint(1, 100) for _ in range(5000)]
    p = packing.Packer(100, 64)
    for n in sizes:
        p.place(n)
        assert p.open <= 64
    assert p.made <= 1.04 * sum(sizes) / 100


# 10: n-gram Jaccard join


def low(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def brute_join(rows, percent=80, size=5):
    sets = []
    for _, t in rows:
        w = low((t or "").encode()).split()
        sets.append(frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent, inverted = list(range(len(rows))), defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in inverted[x])
        for x in s:
            inverted[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        ids[root(i)].append(k)
    return sorted((str(k), len(sets[i]), str(min((x for x in ids[root(i)] if x is not None), default=None))) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("chunk,bits", [(2048, 64), (16, 64), (2048, 6)])  # few bits: many classes have one key
def test_join_is_brute_force(spark, chunk, bits):
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(400)], []
    passage = [rng.choice(words) for _ in range(40)]
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([3, 6, 20, 60, 150, 400]))] + (passage if rng.random() < 0.3 else [])
        for _ in range(rng.choice([1, 1, 2, 3, 10, 40])):
            w = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) * 7 % 5003, " ".join(w[: max(1, int(len(w) * rng.uniform(0.75, 1)))] if rng.random() < 0.3 else w)))
    rows += [(9001, None), (9002, ""), (9003, " \n"), (None, rows[0][1]), rows[5], rows[5]]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, bits=bits).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_join(rows)


def test_join_odd(odd, empty):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join(odd).collect())
    assert got == brute_join([(d, t) for d, t, *_ in ODD])
    assert ngram_join.join(empty).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    base_point = rng.integers(0, 9, 64)
    points = np.maximum(0, base_point + rng.integers(-2, 3, (300, 64)))
    sizes = points.sum(axis=1)
    tree = ngram_join.Tree(points, sizes)
    p, n = tree.points, tree.sizes
    for i in range(0, 300, 7):
        want = [j for j in range(i + 1, 300) if 180 * np.minimum(p[i], p[j]).sum() >= 80 * (n[i] + n[j]) and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])]
        assert sorted(tree.search(i, 80, np.zeros(300, bool)).tolist()) == want


def test_shingles_are_sets_of_words():
    rng = random.Random(1)
    texts = [None, b"", *("".join(rng.choice("abAB \n\t\x0b\x1cé\xa0 ") for _ in range(rng.randint(0, 40))).encode() for _ in range(2000))]
    numbers = {}
    for t, s in zip(texts, shingles.shingle_sets(pa.array(texts, pa.binary())), strict=True):
        w = low(t or b"").split()
        own = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        assert len(s) == len(own)
        assert numbers.setdefault(tuple(s.tolist()), own) == own


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 10)] + [(100, 100 + i) for i in range(50)], "u long, v long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {2: 1, 3: 1, 10: 1, 9: 8} | {100 + i: 100 for i in range(1, 50)}
    assert components.components(edges.where("false")).count() == 0


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    columns, text = docs.columns, dict(docs.select("doc_id", "text").collect())
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True], strict=True):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, BIG).cache()
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        if last:
            assert kept == before
            continue
        assert out.columns == columns and out.count() == len(kept) and kept <= before
        if name == "exact dedup":
            groups = defaultdict(list)
            for d in before:
                groups[text[d]].append(d)
            assert kept == {max(g) for g in groups.values()}
        if name == "n-gram Jaccard join":
            assert kept == {int(c) for d, n, c in brute_join([(d, text[d]) for d in sorted(before)])}
        if name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").select("item_id", "text").collect()]
            assert kept == before - {d for d, _ in brute_contained([(d, text[d]) for d in before], items)}
        docs = out


def test_pipeline_odd(spark, empty, tmp_path):
    """Nulls everywhere, empty and long texts, ties, repeated rows, an empty table, and extra columns that stages use."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars int, digest string, n int, id long, text_ string, statistics int, score double, _text string"
    rest = ("x", 1, 2, "t", 3, 0.5, "own")
    rows = [(i, f"a plain sentence number {i} with words of its own, like {i * 17} and {i * 31} here.", "en", "s", 10, *rest) for i in range(20)]
    near = "a long plain text of which a copy differs in one word only and which goes on for long enough to count as near"
    rows += [(30, near, "en", "s", 1, *rest), (31, near + " indeed", "en", "s", 1, *rest), (31, near + " indeed", "en", "s", 1, *rest)]
    rows += [(None, "a text of no id at all that says this", None, None, None, *rest), (None, "a text of no id at all that says this", None, None, None, *rest), (None, None, None, None, None, *[None] * 7)]
    rows += [(40, None, None, None, None, *rest), (41, "", None, None, None, *rest), (42, "", None, None, None, *rest), (43, " \n", None, None, None, *rest), (44, "word " * 30000, None, None, None, *rest), (45, rows[3][1], "en", "s", 1, *rest), (5, rows[5][1], "fr", "other", 1, *rest)]
    benchmark = [(1, rows[7][1]), (2, None), (3, ""), (None, rows[8][1])]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, frame, items in (("a", rows, benchmark), ("b", [], benchmark), ("c", rows, [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(frame, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        none.write.parquet(f"{folder}/labels.parquet")
        docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder).cache()
            assert docs.columns == spark.createDataFrame([], schema).columns
            assert all(r._text == "own" or r.doc_id is None for r in docs.collect())
            kept.append(sorted((str(r.doc_id), r.text or "") for r in docs.collect()))
        if not frame:
            assert kept == [[]] * 4 and corpus_pipeline.run(spark, folder).count() == 0
            continue
        every = [(str(r[0]), r[1] or "") for r in rows]
        assert kept[0] == sorted(every)
        copies = [*[(str(i), rows[i][1]) for i in range(20) if i != 3], ("30", near), ("31", near + " indeed"), ("None", rows[23][1]), ("42", ""), ("43", " \n"), ("44", "word " * 30000), ("45", rows[3][1])]
        assert kept[1] == sorted(copies)
        assert kept[2] == sorted(c for c in copies if c[0] != "31")
        assert kept[3] == sorted(c for c in copies if c[0] not in (("31", "7", "8") if items else ("31",)))
        got = corpus_pipeline.run(spark, folder)
        assert {str(r.doc_id) for r in got.collect()} == {c[0] for c in kept[3]}
