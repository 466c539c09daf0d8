"""Chat, pseudonyms, sharding, quality, decontamination and mixing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import chat, decontamination, pseudonyms
from glossa.llm.mixing import copies, mix, n_words, source_targets
from glossa.llm.oracles import SQL
from glossa.llm.quality import good_documents, quality
from glossa.llm.sharding import assign, even_map, grow, map_table, rebalance
from tests.llm.fixtures import frame, odd_documents


def words(text):
    return (text or "").encode().split()


# Chat


def test_chat_round_trip(spark):
    r = random.Random(1)
    bits = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[NEXT]", "\\", "[\\INST]", "<|im_end|>", "[INST]", "$1", "\n", " ", "é\U0001f600", "<", "[", "", "</s>[INST] ok [/INST]", "\\\\"]
    rows = []
    for c in range(40):
        for t in range(r.randint(1, 9)):
            rows.append((c, t // 2, r.choice(["user", "assistant", "system", None, "[/ROLE]x"]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))]), "x", 1))
    rows += [(None, 0, "user", "hi", "x", 1), (100, None, "user", "hi", "x", 1), (100, 1, "assistant", "hi", "x", 1), (100, 1, "assistant", "hi", "x", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, blocks long")
    out = chat.format_conversations(turns).select("conv_id", "formatted", "segments", chat.read_back(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "").alias("loss")).collect()
    want = defaultdict(list)
    for c, t, role, text, *_ in rows:
        want[c].append(((t is not None, t or 0), role or "", text or ""))
    assert len(out) == len(want)
    for o in out:
        turns_ = [(role, text) for _, role, text in sorted(want[o.conv_id])]
        assert [tuple(t) for t in o.turns] == turns_
        assert o.loss == "".join(t for role, t in turns_ if role == "assistant")
        assert "".join(s.text for s in o.segments) == o.formatted
        assert o.formatted.count("[ROLE]") == sum(i == 0 or turns_[i - 1][0] != role for i, (role, _) in enumerate(turns_))


# Pseudonyms


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = [
    "card 4068516892505468 and 4068-5168-9250-5468!", "not a card 4068516892505467", "ip 132.201.103.247, 999.1.1.1 and 1.2.3.4.5", "mail a.b@x9.example.com## and A.B@x9.example.com",
    "+1 (555) 555-5657 or 555-555-5657", "born 1984-02-29, not 1983-02-29; 31/12/1999 12/31/1999 1999/12/31", "ssn 123-45-6789 not 000-12-3456", "hash b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "", None, "4068516892505468",
]


def test_pseudonyms(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PII)] + [(None, "9 1.2.3.4", "x"), (0, PII[0], "x")], "doc_id long, text string, found string")
    out = {r.doc_id: r for r in pseudonyms.pseudonymize(docs, "key").collect()}
    assert len(out) == len(PII) + 1
    a, b = re.findall(r"\d[\d-]{15,}", out[0].text)
    assert a == b.replace("-", "") and luhn(a) and a != "4068516892505468" and out[0].n_card == 2
    assert out[10].text == a
    assert out[1].text == PII[1] and out[7].text == PII[7] and out[8].text == "" and out[9].text is None
    assert out[2].n_ip == 1 and "132.201.103.247" not in out[2].text and out[2].text.endswith(", 999.1.1.1 and 1.2.3.4.5")
    assert all(int(o) < 256 for o in re.match(r"ip ([\d.]+),", out[2].text)[1].split("."))
    assert out[3].n_email == 2 and "example.com" not in out[3].text and len(set(re.findall(r"\S+@\S+?\.invalid", out[3].text))) == 1
    phones = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", out[4].text)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and "+1 (" in out[4].text and out[4].n_phone == 2
    assert out[5].n_date == 4 and "1983-02-29" in out[5].text and "1984-02-29" not in out[5].text
    d, m = re.search(r"; (\S+) (\S+) (\S+)$", out[5].text), re.compile(r"\D")
    day, month = m.split(d[1]), m.split(d[2])
    assert m.split(d[3]) == [day[2], day[1], day[0]]
    assert month[2] == day[2]
    assert out[6].n_ssn == 1 and "000-12-3456" in out[6].text and "123-45-6789" not in out[6].text
    assert pseudonyms.pseudonymize(docs, "another key").where("doc_id = 10").first().text != a


def test_feistel_is_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(pseudonyms.permute_digits(F.col("d"), "k", "t").alias("p")).distinct().count() == 1000
    days = spark.range(0, 73049, 1).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    out = days.sample(0.05, 1).select(pseudonyms.date(F.col("d"), "k").alias("p"))
    rows = out.collect()
    assert len({r.p for r in rows}) == len(rows) and all("1900" <= r.p[:4] <= "2099" for r in rows)


# Sharding


def test_sharding(spark):
    docs = frame(spark, seed=8)
    out, slots = assign(docs.select("doc_id", "text"), map_table(spark, [even_map(5, 64), grow(even_map(5, 64))]).where("version = 1"), 64)
    rows = out.collect()
    assert len(rows) == len(odd_documents(8))
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sum(r.n_bytes for r in slots.collect()) == sum(len((t or "").encode()) + 16 for _, t, *_ in odd_documents(8))
    assert assign(frame(spark, []).select("doc_id", "text"), map_table(spark, [even_map(5, 64)]), 64)[0].count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_growing_moves_rows_only_to_the_new_shard(n):
    before = even_map(n)
    after = grow(before)
    moved = [(a, b) for a, b in zip(before, after, strict=True) if a != b]
    assert all(b == n for _, b in moved)
    sizes = Counter(after).values()
    assert max(sizes) - min(sizes) <= max(sizes) * 0.1 + 2


def test_rebalance():
    r = random.Random(1)
    owners, weight = even_map(8, 512), [r.randrange(1, 1000) * (1 + 9 * (i % 50 == 0)) for i in range(512)]
    new = rebalance(owners, weight)
    load = Counter()
    for s, w in zip(new, weight, strict=True):
        load[s] += w
    assert max(load.values()) <= sum(weight) / 8 * 1.05
    assert sum(a != b for a, b in zip(owners, new, strict=True)) < 200


# Quality


def brute_stats(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if x.encode().split()]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(re.findall(r"[!-/:-@\[-`{-~]", t)), len(set(w))


def test_quality(spark):
    rows = odd_documents(9)
    out = quality(frame(spark, seed=9)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_marks, r.n_distinct) for r in out)
    assert got == Counter((r[0], *brute_stats(r[1])) for r in rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out)
    assert all(not (r.base_failed and r.kept) for r in out) and any(r.kept for r in out)
    assert {r.doc_id: r.kept for r in out}[5011] is False
    docs = frame(spark, seed=9)
    kept = good_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if r.kept)
    assert quality(frame(spark, [])).count() == 0


def test_quality_of_many_groups(spark, monkeypatch):
    """Salted thresholds give the rows that broadcast ones give; a group holds most rows."""
    rows = [(i, " ".join(["word", "other", "third"][(i + j) % 3] * (1 + j % 4) for j in range(12 + i % 30)), "en", "hot" if i % 5 else f"s{i % 7}") for i in range(200)] + [(None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    few = sorted(map(repr, quality(docs).collect()))
    monkeypatch.setattr("glossa.llm.quality.MOST_GROUPS", 0)
    assert sorted(map(repr, quality(docs).collect())) == few and len(few) == 202


def test_quality_thresholds_follow_the_group(spark):
    """Long words are usual in one language and odd in the other."""
    r = random.Random(3)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(11 if i % 2 else 5)) for _ in range(60)), "xx" if i % 2 else "en", "s") for i in range(120)]
    rows += [(500, " ".join("".join(r.choice("abcdefgh") for _ in range(11)) for _ in range(60)), "en", "s"), (501, " ".join("".join(r.choice("abcdefgh") for _ in range(11)) for _ in range(60)), "xx", "new")]
    out = {x.doc_id: x.kept for x in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(120)) and not out[500] and out[501]


def test_quality_of_long_unspaced_words(spark):
    """One paragraph is a word: its length has no upper end in the sketches; what is far from the group still goes."""
    r = random.Random(4)

    def text(least, most, n=12):
        return " ".join("".join(chr(0x4E00 + r.randrange(3_000)) for _ in range(r.randint(least, most))) for _ in range(n))

    rows = [(i, text(130, 170), "zh", "a") for i in range(60)] + [(i, text(85, 125), "th", "a") for i in range(100, 160)]
    rows += [(i, text(30_000, 30_000, 10), "blob", "a") for i in range(200, 230)]
    rows += [(900, text(900, 900), "zh", "a"), (901, text(5, 5, 60), "zh", "a"), (902, text(60_000, 60_000, 10), "blob", "a")]
    out = {x.doc_id: x.kept for x in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {d for d, kept in out.items() if not kept} == {900, 901, 902}
    db = duckdb.connect()
    db.register("documents", pa.table({c: [x[i] for x in rows] for i, c in enumerate(("doc_id", "text", "lang", "source"))}))
    assert dict(db.execute(f"SELECT doc_id, kept FROM ({SQL['op7_quality']})").fetchall()) == out


def test_bounds_follow_the_spread_of_the_group(spark):
    """A group of even texts bounds the mean word length closely, one of mixed texts widely: no cutoff is shared."""
    even = [(i, " ".join(["abcde", "fghijk"][(i + j) % 2] for j in range(120)), "en", "even") for i in range(60)]
    mixed = [(100 + i, " ".join("abcdefghijkl"[: 3 + i % 9] for _ in range(120)), "fr", "mixed") for i in range(60)]
    odd = " ".join("abcdefgh" for _ in range(120))
    out = {x.doc_id: x for x in quality(spark.createDataFrame([*even, *mixed, (900, odd + " one two three four", "en", "even"), (901, odd + " one two three four", "fr", "mixed")], "doc_id long, text string, lang string, source string")).collect()}
    assert out[900].mean_chars_far <= 60 and out[901].mean_chars_far >= 1000


def prose(r, marks, n=200):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) + r.choice(marks) for _ in range(n))


def test_no_fixed_cutoff_gives_the_verdict(spark):
    """Half of the words of code end in marks and hardly any of plain text: what is usual in one source is odd in the other."""
    r = random.Random(8)
    rows = [(i, prose(r, ["", "", "", "", "", ",", "."]), "en", "plain") for i in range(80)]
    rows += [(100 + i, prose(r, [";", "()", "{}", "", ""]), "en", "code") for i in range(80)]
    rows += [(900, prose(r, [";", "()", "{}", "", ""]), "en", "plain"), (901, prose(r, ["{};", "(){}", "[]<>!!"]), "en", "code")]
    out = {x.doc_id: x for x in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[900].base_failed and {d for d, x in out.items() if not x.kept} == {900, 901}
    rate = {d: x.n_marks / x.n_words for d, x in out.items()}
    assert rate[900] <= max(v for d, v in rate.items() if 100 <= d < 200)  # a cutoff that drops 900 drops good code


def test_copies_do_not_narrow_the_bounds(spark):
    r = random.Random(9)
    some = [(i, prose(r, ["", "", ",", "."]), "en", "s") for i in range(60)]
    bounds = []
    for copies in (0, 500):
        rows = some + [(1000 + i, some[0][1], "en", "s") for i in range(copies)]
        out = quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
        assert all(x.kept for x in out)
        bounds.append((out[0].mean_chars_far, out[0].marks_far, out[0].variety_far))
    assert all(0.7 * a <= b <= 1.3 * a for a, b in zip(*bounds, strict=True))


def test_tasks_of_null_and_empty_texts(spark, tmp_path):
    """Tasks, files and tables whose texts are all null or empty."""
    kind = "doc_id long, text string, lang string, source string"
    nothing = spark.createDataFrame([(i, None if i % 2 else "", "en", "a") for i in range(8)], kind)
    assert Counter((x.n_words, x.n_marks, x.base_failed, x.kept) for x in quality(nothing).collect()) == {(0, 0, True, False): 8}
    assert good_documents(nothing).count() == 0
    r = random.Random(1)
    good = spark.createDataFrame([(100 + i, prose(r, ["", ","]), "en", "a") for i in range(40)], kind)
    nothing.limit(3).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    good.coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert quality(docs).where("kept").count() == good_documents(docs).count() == 40
    assert good_documents(good.limit(0)).count() == 0


# Decontamination


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 40)))) for i in range(25)] + [(100, None), (101, ""), (102, "only three words")]
    rows = []
    for i in range(160):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if i % 2:
            item = items[r.randrange(25)][1].split()
            for _ in range(r.randint(0, len(item) // 4)):
                k, kind = r.randrange(len(item)), r.randrange(3)
                item[k : k + 1] = [[], [r.choice(vocabulary)], [item[k], r.choice(vocabulary)]][kind]
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() for x in item] if i % 4 == 1 else item
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "Only THREE words"), (None, items[0][1]), (903, items[1][1]), (903, items[1][1])]
    docs = spark.createDataFrame([(*x, 1, "a") for x in rows], "doc_id long, text string, did long, edits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, x in items:
            item = (x or "").lower().split()
            if item and (e := brute_edits(item, (t or "").lower().split())) <= len(item) // 5:
                want.add((d, i, e))
    got = {(x.doc_id, x.item_id, x.edits) for x in decontamination.found_items(docs, bench).collect()}
    assert {x[:2] for x in got} <= {x[:2] for x in want}
    assert len({x[:2] for x in got}) >= 0.97 * len(want) and len(want) > 60
    exact = {x for x in want if x[2] == 0}
    assert exact <= got
    bad = {d for d, _, _ in got}
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert Counter(x.doc_id for x in clean.collect()) == Counter(d for d, _ in rows if d not in bad)
    monkeypatch.setattr(decontamination, "BLOCK", 800)
    assert {(x.doc_id, x.item_id, x.edits) for x in decontamination.found_items(docs, bench).collect()} == got
    assert decontamination.found_items(docs, bench.limit(0)).count() == 0
    assert decontamination.found_items(docs.limit(0), bench).count() == 0


def test_decontamination_of_long_and_common_items(monkeypatch):
    """A very long item takes no more room beside short ones; pieces that many items share are compared in parts, with one result."""
    r = random.Random(8)
    common = "a piece of many items stands here"
    items = [(i, f"{common} {' '.join(f'w{r.randrange(500)}' for _ in range(14))}") for i in range(60)] + [(99, " ".join(f"l{i}" for i in range(3_000)))]
    texts = [" ".join([common] * 300 + [items[7][1]] + [common] * 300), " ".join(f"l{i}" for i in range(3_000)), common, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([0] * 4, pa.int64()), pa.array(texts)], ["did", "th", "text"])
    table = [next(decontamination.search("whole", items[:-1])(iter([batch]))).to_pylist()]
    monkeypatch.setattr(decontamination, "MOST_HITS", 64)
    table.append(next(decontamination.search("parts", items[:-1])(iter([batch]))).to_pylist())
    assert table[0] == table[1] and [(x["did"], x["item_id"], x["edits"]) for x in table[0]] == [(0, 7, 0)]
    longest = decontamination.Items(items[-1:] + items[:3])
    assert sum(h.nbytes for h in longest.words) < 1 << 16 and all(len(t[0]) < 1600 for _, table in longest.sizes.values() for t in table)


@pytest.mark.parametrize("n", [5, 8, 10, 12, 15, 20, 40, 60, 100, 200, 400])
def test_recall_at_the_most_edits(n):
    """At n // 5 edits between other words, by kind of edit and mixed: at least 0.95 of the planted items are found."""
    r = random.Random(n)

    def other():
        return f"x{r.randrange(10**6)}"

    items = [(i, " ".join(f"w{r.randrange(3_000)}" for _ in range(n))) for i in range(40 if n < 100 else 12)]
    texts, want = [], []
    for kind in (0, 1, 2, None):
        for i, t in items:
            w = t.split()
            for k in sorted(r.sample(range(n), n // 5), reverse=True):
                w[k : k + 1] = [[other()], [w[k], other()], []][r.randrange(3) if kind is None else kind]
            want.append((len(texts), i))
            texts.append(" ".join([other() for _ in range(r.randrange(90))] + w + [other() for _ in range(r.randrange(90))]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)], ["did", "th", "text"])
    rows = [x for b in decontamination.search(f"recall {n}", items)(iter([batch])) for x in b.to_pylist()]
    found = {(x["did"], x["item_id"]) for x in rows}
    each = [sum(p in found for p in want[k : k + len(items)]) / len(items) for k in range(0, len(want), len(items))]
    assert sum(each) / 4 >= 0.95 and min(each) >= 0.9, each
    assert all(x["edits"] <= n // 5 and 0 <= x["start"] < 90 + n // 5 for x in rows)


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] <= level * w[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark):
    rows = odd_documents(10, 200)
    docs = frame(spark, rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    got = {r.source: r.target for r in source_targets(docs.select("source", n_words().alias("size"))).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    out = copies(docs.select("doc_id", "source", n_words().alias("size"))).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], len(words(r[1]))) for r in rows)
    taken, expected = Counter(), Counter()
    for r in out:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies
        expected[r.source] += want[r.source] / sizes[r.source]
    assert all(abs(taken[s] - expected[s]) < 1 for s in sizes)
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == sum((Counter({r.doc_id: r.copies}) for r in out), Counter())
    assert mix(frame(spark, [])).count() == 0


def test_crc_and_hash_of_odd_texts(spark):
    rows = odd_documents(11, 6)
    out = frame(spark, rows).select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("c"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("s")).collect()
    assert Counter((r.doc_id, r.c, r.s) for r in out) == Counter((d, zlib.crc32((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows)


def test_mix_of_rows_with_one_id_agrees_in_reruns(spark):
    rows = [(7, f"a{i} b{i} c{i}", "s", None if i % 3 else i) for i in range(90)] + [(None, f"d{i} e f", "t", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    first, again = (Counter(map(tuple, mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert first == again


def test_good_documents_tell_nulls_apart(spark):
    r = random.Random(6)
    long_words, short_words = (" ".join("".join(r.choice("abcdefgh") for _ in range(n)) for _ in range(60)) for n in (11, 5))
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)), None, "x") for i in range(40)]
    rows += [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(11)) for _ in range(60)), "x", None) for i in range(40, 80)]
    rows += [(900, long_words, None, "x"), (900, long_words, "x", None), (901, short_words, None, "x"), (901, short_words, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {tuple(x)[::2] + (x.source,) for x in good_documents(docs).collect() if x.doc_id >= 900}
    assert kept == {(900, "x", None), (901, None, "x")}


def test_cards_among_other_digits_and_dates_of_one_form(spark):
    card = "4068516892505468"
    texts = [f"card {card} 12/25", f"12 {card} 7", f"{card} {card}", "4068 5168 9250 5468 12 x", f"no {card}1"]
    out = [x.text for x in pseudonyms.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    new = re.match(r"card (\d{16}) 12/25", out[0])[1]
    assert new != card and luhn(new)
    assert out[1:3] == [f"12 {new} 7", f"{new} {new}"] and re.sub(r"\D", "", out[3])[:16] == new and out[3].endswith(" 12 x") and out[4] == texts[4]
    days = spark.range(0, 73049, 29).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    forms = days.select(F.explode(F.array(F.date_format("d", "dd/MM/yyyy"), F.when(F.day("d") > 12, F.date_format("d", "MM/dd/yyyy")))).alias("s")).where("s is not null")
    got = forms.select("s", pseudonyms.date(F.col("s"), "k").alias("p")).agg(F.count_distinct("s"), F.count_distinct("p"), F.count_if(pseudonyms.day(F.col("p")).isNull())).first()
    assert got[0] == got[1] > 4000 and got[2] == 0
