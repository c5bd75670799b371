"""Each corpus operator on rows with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import decontaminate, jaccard, langid, licences, mixing, pii, ppm, quality, queries, suffix, warc
from latticework.llm.common import remainder, utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept string, score double"
R = random.Random(11)


def prose(n, words=("stone", "river", "the", "of", "was", "green", "mountain", "light", "walked", "under", "house", "quickly", "silver", "and", "old", "storm")):
    return " ".join(R.choice(words) + R.choice(("", "", "", ",", ".")) + R.choice(("", "a", "en", "s")) for _ in range(n))


ITEM = "quartz lamps hum beneath seven copper bridges while pale herons count the drifting barges at dawn"
BASE = prose(300)
SWAPPED = " ".join(w if i % 120 else "zzz" for i, w in enumerate(BASE.split()))
DOCS = [
    (1, BASE), (2, BASE), (3, SWAPPED), (3, prose(80)), (None, prose(60)), (None, None), (4, None), (5, ""), (6, " \n\t "), (7, "one two three"), (8, "one two three"), (8, "one two three"),
    (9, prose(20) + " " + ITEM + " " + prose(20)), (10, prose(20) + " " + ITEM.replace("pale", "dim").replace("Copper", "x") + " " + prose(5)), (11, "spam " * 3000), (12, prose(15_000)),
    (13, "mail bob.x@ex-ample.co.uk, ip 10.0.0.255 or 999.1.1.1, card 4539 5787 6362 1486, call +1 (736) 555-2678 or bob at example dot com"), (14, "é" * 500), (15, "line\nline\nline\n\nother #$%"),
    (16, "Released under the MIT License."), (17, BASE[:900] + prose(50)), (18, "\x00\x01 nul"), (19, "THE CAT!! " * 5 + "ends"), (20, BASE.lower()),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr")[k % 2] if k % 5 else None, f"src{k % 3}" if k % 7 else None, len(t or ""), "k", "c", 0.5) for k, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_masks_catch_all_substitutions():
    for a, b in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(all(p + i not in (a, b) for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(decontaminate.WINDOW - len(m) + 1))


@pytest.mark.parametrize("max_seeds", [1_000_000, 0])
def test_decontaminate(spark, docs, max_seeds):
    items = [(1, ITEM), (2, "Too short, this"), (3, None), (4, "one two three"), (5, " ".join(ITEM.split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def toks(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    want = []
    for i, t in DOCS:
        found, best = set(), 0
        d = toks(t)
        for item, text in items:
            w = toks(text)
            n = len(w)
            if n < 4:
                continue
            span = min(n, 13)
            for s in range(-n, len(d)):
                same = [0 <= s + q < len(d) and d[s + q] == w[q] for q in range(n)]
                m = max(sum(same[q : q + span]) for q in range(n - span + 1))
                if m >= span - (2 if n >= 13 else 1 if n >= 8 else 0):
                    found.add(item)
                    best = max(best, m)
        want.append((i, bool(found), len(found), ",".join(str(x) for x in sorted(found)), best))
    out = decontaminate.find(docs.withColumn("items", F.lit(1)), bench, max_seeds)
    assert got(out, "doc_id", "contaminated", "n_items", "items", "best_match") == sorted(want, key=str)
    assert decontaminate.find(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find(docs.limit(0), bench).count() == 0


def test_matching_statistics():
    r = random.Random(2)
    for _ in range(40):
        s = bytes(r.choice(b"ab") for _ in range(r.randint(0, 90))) + b"\xff"
        n = len(s)
        common = lambda i, j: next((k for k in range(min(n - i, n - j)) if s[i + k] != s[j + k]), min(n - i, n - j))
        assert suffix.RunIndex(np.frombuffer(s, np.uint8)).matching_statistics().tolist() == [max([0] + [common(i, j) for j in range(n) if j != i]) for i in range(n)]


@pytest.mark.parametrize("length, gram", [(400, 100), (40, 12)])
def test_suffix(docs, length, gram):
    raw = [(t or "").encode() for _, t in DOCS]
    many = Counter(t[p : p + length] for t in raw for p in range(len(t) - length + 1))
    want = []
    for (i, _), t in zip(DOCS, raw, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if many[t[p : p + length]] > 1:
                gone[p : p + length] = True
        left = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        want.append((i, len(t), len(t) - len(left), int((gone[1:] > gone[:-1]).sum() + gone[0]), hashlib.sha256(left).hexdigest()))
    assert got(suffix.dedup(docs, length, gram), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    assert suffix.dedup(docs.limit(0)).count() == 0
    short = 5 * length // 8
    many = Counter(t[p : p + short] for t in raw for p in range(len(t) - short + 1))
    again = [sum(any(many[t[q : q + short]] > 1 for q in range(max(0, p - short + 1), min(p, len(t) - short) + 1)) for p in range(len(t))) if len(t) < 5_000 else None for t in raw]
    out = suffix.dedup(docs, length, gram, passage=short)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    assert Counter((r.doc_id, r.n_bytes, r.n_repeated) for r in out.collect() if r.n_bytes < 5_000) == Counter((i, len(t), n) for (i, _), t, n in zip(DOCS, raw, again, strict=True) if n is not None)


def base(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isascii() and c.isdigit()]
        if 12 <= len(d) <= 19 and sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base_spans():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("aé@..-+ 01234567890()") for _ in range(r.randint(0, 45)))
        spans = [s for s in base(t) if s[2] != "card" or any(c in "123456789" for c in t[s[0] : s[1]])]
        assert [s for s in pii.base_spans(t) if s[2] != "card" or any(c in "123456789" for c in t[s[0] : s[1]])] == spans


def test_pii(spark, docs):
    out = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone): r.spans for r in pii.find(docs).collect()}
    for i, t in DOCS:
        b = base(t or "")
        spans = out[(i, hashlib.sha256(pii.written(b).encode()).hexdigest(), *(sum(s[2] == k for s in b) for k in pii.KINDS))].split(",")
        assert set(pii.written(b).split(",")) <= set(spans)
        if i == 13:
            assert [s.split(":")[0] for s in spans] == ["email", "ip", "card", "phone", "email"]
        elif i != 13:
            assert spans == [""]
    clean = pii.redact(docs.where("doc_id = 13 or text is null"))
    assert clean.columns == docs.columns and clean.where("text is null").count() == 2
    r = clean.where("doc_id = 13").first()
    assert r.text == "mail <EMAIL>, ip <IP> or 999.1.1.1, card <CARD>, call <PHONE> or <EMAIL>" and r.n_chars == len(r.text)
    assert pii.find(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_pii_held_out():
    model, least = pii.train()
    true = Counter()
    for text, spans in pii._sentences(1500, 99):
        found = set(pii.all_spans(text, base_ := pii.base_spans(text), model, least)) - set(base_)
        true["right"] += len(found & spans)
        true["wrong"] += len(found - spans)
        true["all"] += len(spans - set(base_))
    assert true["right"] / (true["right"] + true["wrong"]) > 0.93 and true["right"] / true["all"] > 0.7


def test_warc(spark):
    pages = spark.createDataFrame([(i if i % 50 else None, f"u{i}" if i % 7 else None, "x" * (i * 37 % 4000) if i % 11 else None) for i in range(600)], "page_id long, url string, html string")
    out = warc.audit_pages(pages.repartition(5))
    r = lambda i: crc32((b"" if i is None else str(i).encode())) % 97
    want = Counter()
    for p in pages.collect():
        whole, kind = p.html or "", r(p.page_id)
        if kind == 2:
            want[(p.page_id, "missing")] += 1
        elif kind == 0 or (kind == 1 and whole):
            want[(p.page_id, "modified")] += 1
    assert Counter((x.record_id, x.status) for x in out.collect()) == want
    a = spark.createDataFrame([(1, 0, 5, "a"), (2, 5, 5, "b"), (2, 10, 5, "b"), (None, 100, 1, "c")], "record_id long, offset long, length long, digest string")
    assert warc.audit(a, a, 8).count() == 0 and warc.audit(a.limit(0), a.limit(0)).count() == 0
    b = spark.createDataFrame([(1, 0, 5, "x"), (2, 5, 5, "b"), (None, 100, 1, "c"), (9, 5000, 1, "d")], a.schema)
    assert got(warc.audit(a, b, 8), "record_id", "offset_a", "offset_b", "status") == [(1, 0, 0, "modified"), (2, 10, None, "missing"), (9, None, 5000, "extra")]
    total = warc.offsets(a.drop("offset")).orderBy("offset").collect()
    assert [(x.record_id, x.offset) for x in total] == [(None, 0), (1, 1), (2, 6), (2, 11)]


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 1, None), (12, 1, 0), (11, 0, 0), (None, 1, 0), (999, 1, 0), (20, 1, 1)], "doc_id long, quality int, toxic int")
    good = {1, 3, 12}
    grams = lambda t: quality.bins(np.frombuffer((t or "").encode(), np.uint8))
    raw = sum((np.bincount(grams(t), minlength=quality.BINS) for _, t in DOCS), np.zeros(quality.BINS))
    trusted = sum((np.bincount(grams(t), minlength=quality.BINS) for i, t in DOCS if i in good), np.zeros(quality.BINS))
    ratio = np.rint(65536 * (np.log2((trusted + 1) / (trusted.sum() + quality.BINS)) - np.log2((raw + 1) / (raw.sum() + quality.BINS))))
    want = []
    for i, t in DOCS:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        kept = not failed and ratio[grams(t)].sum() >= quality.THRESHOLD * len(grams(t))
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside), failed, bool(kept)))
    out = quality.assess(docs, labels)
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(want, key=str)
    assert quality.assess(docs.limit(0), labels).count() == 0
    assert got(quality.assess(docs, None), "kept") == got(quality.assess(docs, labels.limit(0)), "kept")


def test_quality_threshold_from_labels(spark):
    r = random.Random(8)
    some = lambda n: " ".join(r.choice(("stone", "river", "mountain", "light", "house", "storm", "green", "silver")) for _ in range(n))
    texts = [some(80) if i < 400 else f"{some(40)} vile wretch {some(40)}" for i in range(460)]
    rows = spark.createDataFrame([(i, f"{t} {i}") for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(i, 1, 1) for i in range(400, 430)], "doc_id long, quality int, toxic int")
    out = quality.assess(rows, labels).where("not base_failed").cache()
    clean, toxic = out.where("doc_id < 400"), out.where("doc_id >= 400")
    assert clean.where("kept").count() >= 0.95 * clean.count() > 0 and toxic.where("not kept").count() >= 0.95 * toxic.count() > 0
    assert toxic.where("llr > -0.5").count() == toxic.count()


def test_mixing(spark, docs):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = mixing.mix(docs, ratio=3.0)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert set(docs.columns) <= set(out.columns) and got(out, "doc_id", "copy", "mix_key") == got(mixing.mix(docs.repartition(7), ratio=3.0, max_sources=0), "doc_id", "copy", "mix_key")
    many = out.groupBy("mix_key").count().agg(F.max("count")).first()[0]
    assert many == 2  # the repeated row
    only = mixing.mix(docs, {"src1": 1.0, "gone": 5.0})
    assert {r.source for r in only.select("source").distinct().collect()} <= {"src1"}
    wide = spark.range(3000).selectExpr("id doc_id", "'abc' text", "case when id < 1000 then 'a' when id < 2999 then 'b' else 'c' end source")
    n = {r.source: r.n for r in mixing.mix(wide, {"a": 1, "b": 1, "c": 1}, ratio=1.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(n[s] - 1000) < 150 for s in "abc")  # the one document of c, with a mean over MAX_MEAN, too


def test_jaccard(docs):
    def shingled(t):
        w = words(lower(t))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingled(t) for _, t in DOCS]
    part = list(range(len(DOCS)))
    for a, b in itertools.combinations(range(len(DOCS)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            part = [part[a] if p == part[b] else p for p in part]
    want = []
    for k, (i, _) in enumerate(DOCS):
        ids = [j for p, (j, _) in zip(part, DOCS, strict=True) if p == part[k] and j is not None]
        want.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    assert got(jaccard.join(docs), "doc_id", "n_shingles", "component_id") == sorted(want, key=str)
    kept = jaccard.distinct(docs)
    groups = len({part[k] for k in range(len(DOCS)) if sets[k]}) + len({(i, t) for (i, t), s in zip(DOCS, sets, strict=True) if not s})
    assert kept.count() == groups and kept.columns == docs.columns
    assert jaccard.join(docs.limit(0)).count() == 0


def test_jaccard_large_near_group(spark):
    """Neighbours and long tiles: many variants of one text, some out of reach of others, beside unlinked ones."""
    r = random.Random(5)
    whole = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(whole)
        for _ in range(r.choice((0, 1, 2, 3, 4))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(116)) for _, t in rows]
    part = list(range(150))
    for a, b in itertools.combinations(range(150), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            part = [part[a] if p == part[b] else p for p in part]
    first = {}
    for i, p in enumerate(part):
        first.setdefault(p, i)
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert got(out, "doc_id", "component_id") == sorted(((i, first[p]) for i, p in enumerate(part)), key=str)


def test_bitmap_bounds():
    r = np.random.default_rng(1)
    for n in (1, 5, 60, 3000):
        pool = r.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = np.unique(pool[: n + n // 2]), np.unique(pool[n // 3 :])
        assert jaccard.bound(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_language(spark):
    r = random.Random(8)
    parts = {"aa": ("ka", "lo", "mi", "tu"), "bb": ("sch", "ung", "ein", "ver"), "cc": ("çé", "ou", "eau", "ñí")}
    rows = [(k, " ".join("".join(r.choice(parts[g]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 200))), g) for k in range(240) for g in [r.choice(list(parts))]]
    rows += [(None, "kalo mitu", "aa"), (1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "bb"), (1003, "schungein", None), (1000, None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = remainder("doc_id", 5) == 0
    out = langid.predict(docs, langid.train(docs.where(~held), sample_docs=300), held).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    assert sorted((x.doc_id, x.lang_pred) for x in out if x.lang_pred == "und") == [(1000, "und"), (1000, "und"), (1001, "und"), (1002, "und")]
    truth = {i: g for i, _, g in rows}
    told = [(truth[x.doc_id], x.lang_pred) for x in out if x.held_out and x.doc_id is not None and x.doc_id < 240]
    assert len(told) > 20 and sum(a == b for a, b in told) / len(told) > 0.95
    assert langid.train(docs.limit(0)) is None and langid.predict(docs, None, held).where("lang_pred <> 'und'").count() == 0


def test_licences(spark, docs):
    out = licences.scan(docs)
    assert out.count() == len(DOCS) and got(out.where("licence_id is not null"), "doc_id", "licence_id", "n_notices", "notices") == [(16, "MIT", 1, "MIT")]
    bsd = next(t for n, t in licences.KNOWN if n == "BSD-3-Clause")
    texts = [(1, "Copyright (c) 2020, Somebody\nAll rights reserved.\n\n" + bsd.replace("\n", "\n\n * ").upper()), (2, bsd[:-30]), (3, "Licenced under the Apache License,   Version 2.0"), (4, "x\nLicensed under CC BY-NC 4.0.\ny"), (5, None), (5, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    want = [(1, "BSD-3-Clause", 0), (2, None, 0), (3, "Apache-2.0", 1), (4, None, 1), (5, None, 0), (5, None, 0)]
    assert got(licences.scan(rows), "doc_id", "licence_id", "n_notices") == want
    assert [x[:2] for x in got(licences.scan(rows, max_known=0), "doc_id", "licence_id")] == [x[:2] for x in want]
    assert licences.scan(rows.limit(0)).count() == 0


def test_ppm(docs, spark):
    held = remainder("doc_id", 7) == 2
    learnt = [t for i, t in DOCS if crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    freq = Counter(w for t in learnt for w in [*words(lower(t)), ""])
    total, distinct = sum(freq.values()), len(freq)
    want = []
    for i, t in DOCS:
        own = [*words(lower(t)), ""]
        want.append((i, crc32(b"" if i is None else str(i).encode()) % 7 == 2, len(own), sum(freq[w] > 0 for w in own), total, round(sum(math.log10((freq[w] + 1) / (total + distinct + 1)) for w in own), 6)))
    for most in (200_000, 5):  # all words looked up, or nearly all joined
        out = ppm.score(docs, held, max_frequent=most)
        assert got(out.withColumn("base_score", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == sorted(want, key=str)
    assert out.where("score >= 0 or score is null").count() == 0
    assert ppm.score(docs.limit(0), held).count() == 0
    none = ppm.score(docs, F.lit(True)).where("doc_id = 5").first()
    assert (none.train_tokens, none.n_known) == (0, 0) and abs(none.score + math.log10(256)) < 1e-6


def test_ppm_model():
    r = random.Random(3)
    some = lambda n: ["".join(r.choice("ab cé") for _ in range(r.randint(0, 40))).encode() for _ in range(n)]
    train, texts, d = some(30), [*some(20), b"", b"zz a"], ppm.ORDER
    grams, counts = Counter(), defaultdict(Counter)
    for t in train:
        s = b"\xff" * d + t + b"\xff"
        for i in range(d, len(s)):
            for o in range(d + 1):
                counts[s[i - o : i]][s[i]] += 1
                if o > 1:
                    grams[(o, int.from_bytes(s[i - o : i + 1], "big"))] += 1
    model = ppm.Model([tuple(np.array(x) for x in zip(*((g, n) for (k, g), n in grams.items() if k == o), strict=True)) for o in range(2, d + 1)])
    import pyarrow as pa

    got_ = model.score(*utf8(pa.array([t.decode() for t in texts])))
    for t, score in zip(texts, got_, strict=True):
        s, total = b"\xff" * d + t + b"\xff", 0.0
        for i in range(d, len(s)):
            out, p = set(), 1.0
            for o in range(d, -1, -1):
                c = {k: n for k, n in counts[s[i - o : i]].items() if k not in out}
                if c:
                    whole = sum(c.values()) + len(c)
                    if s[i] in c:
                        p *= c[s[i]] / whole
                        break
                    p *= len(c) / whole
                    out |= set(c)
            else:
                p /= 256 - len(out)
            total += math.log10(p)
        assert abs(score - total) < 1e-4


def test_ppm_keeps_all_contexts(spark):
    r = random.Random(5)
    train = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz 0123") for _ in range(30_000)) for _ in range(4)]
    held = [train[0][100:400], train[3][-200:], "abc zz", "ÿé"]
    d, counts = ppm.ORDER, [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    frame = lambda t: b"\xff" * d + t.encode() + b"\xff"
    for s in map(frame, train):
        for i in range(d, len(s)):
            for o in range(d + 1):
                counts[o][s[i - o : i]][s[i]] += 1
    assert len(counts[4]) > 65_536
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(train + held)], "doc_id int, text string").repartition(3)
    got_ = {x.doc_id: x.score for x in ppm.score(rows, F.col("doc_id") >= len(train)).collect()}
    for k, s in enumerate(map(frame, held), len(train)):
        total = 0.0
        for i in range(d, len(s)):
            out, p = set(), 1.0
            for o in range(d, -1, -1):
                c = {b: n for b, n in counts[o].get(s[i - o : i], {}).items() if b not in out}
                if c:
                    whole = sum(c.values()) + len(c)
                    if s[i] in c:
                        p *= c[s[i]] / whole
                        break
                    p *= len(c) / whole
                    out |= set(c)
            else:
                p /= 256 - len(out)
            total += math.log10(p)
        assert abs(got_[k] - total) < 1e-6


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    at = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        want = con.sql(sql)
        assert got(queries.QUERIES[name](spark, at), *want.columns) == sorted(want.fetchall(), key=str), name


def test_pipeline(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    a = stage["quality"](spark, documents, at)
    assert got(a, "doc_id") == got(quality.assess(documents, labels).where("kept"), "doc_id")
    b = stage["near_duplicates"](spark, a, at)
    assert got(b, "doc_id") == got(jaccard.join(a).select("component_id").distinct(), "component_id")
    c = stage["decontamination"](spark, b, at)
    assert got(c, "doc_id") == got(decontaminate.find(b, spark.read.parquet(f"{at}/benchmark.parquet")).where("not contaminated"), "doc_id")
    d = stage["personal_data"](spark, c, at)
    assert {x.columns == documents.columns for x in map(lambda f: f, (a, b, c, d))} == {True}
    assert pii.find(d).where("n_email + n_ip + n_phone > 0").count() == 0
    assert got(corpus_pipeline.run(spark, at), "doc_id", "text", "copy") == got(mixing.mix(d), "doc_id", "text", "copy")
