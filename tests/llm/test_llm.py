"""The corpus operators against brute-force versions, public libraries and exact round trips."""

import hashlib
import json
import random
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import _words, bpe, chat, decontaminate, fingerprint, language_id, line_dedup, near_duplicates, quality, substring_dedup, warc
from millrace.llm._graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, id string, `rank` int"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs(spark, texts, ids=None):
    """With extra columns whose names the operators use themselves."""
    ids = ids or range(len(texts))
    rows = [(i, t, None if i is None or i % 5 == 4 else "en", None if i is not None and i % 7 == 3 else f"s{(i or 0) % 30}", len(t or ""), "x", "y", 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def sentences(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéßж") for _ in range(rng.randrange(1, 8))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    base = sentences(1, 60)
    rng = random.Random(2)
    out = list(base)
    for t in base[:20]:
        w = t.split()
        out.append(t)
        for _ in range(2):
            v = list(w)
            v[rng.randrange(len(v))] = "CHANGED"
            out.append(" ".join(v))
        out.append(" ".join(rng.choice(base).split()[:30] + w + ["tail"]))
    return [*out, None, "", " \t\n", "one", "One", "a b c", "word " * 300, "x" * 5000, "Ünï\x00cödé\x1c‑ text here"]


def write_tables(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


# ---------------------------------------------------------------- words


def test_words_and_runs(corpus):
    texts = pa.array(corpus)
    w = _words.words(texts, fold=_words.LOWER)
    said = [BLANK.findall((t or "").translate(LOWER)) for t in corpus]
    assert np.diff(w.first).tolist() == [len(x) for x in said]
    flat = [x for own in said for x in own]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == flat
    by = {}
    for x, h in zip(flat, w.hash.tolist()):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    runs, inside = w.runs(3)
    seen = {}
    for i in np.flatnonzero(inside):
        assert seen.setdefault(tuple(flat[i : i + 3]), runs[i]) == runs[i]
    alone = _words.words(texts.slice(5, 1), fold=_words.LOWER)
    assert alone.hash.tolist() == w.hash[w.first[5] : w.first[6]].tolist()


def test_word_classes_of_any_byte():
    text = "".join(map(chr, range(0, 300)))
    got = _words.words(pa.array([text]), _words.ALPHANUMERIC, _words.LOWER)
    assert [got.data[a:b].tobytes().decode() for a, b in zip(got.start, got.end)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


# ---------------------------------------------------------------- 1 fingerprints


def py_anchors(text):
    pieces = re.findall(rf"[^ \t\n\x0b\f\r]{{1,{fingerprint.PIECE}}}", text)
    return pieces


def test_syncmers_depend_on_the_kmer_alone(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    rows = spark.createDataFrame([(t,), ("intro words here " + t,), (t + " and more",)], "text string").select(fingerprint.syncmers(F.col("text")).alias("a")).collect()
    first = [x.h for x in rows[0].a]
    assert first and set(first) <= {x.h for x in rows[1].a} and set(first) <= {x.h for x in rows[2].a}
    shift = len(py_anchors("intro words here "))
    assert {(x.at + shift, x.h) for x in rows[0].a} <= {(x.at, x.h) for x in rows[1].a}
    assert {(x.at, x.h) for x in rows[0].a} <= {(x.at, x.h) for x in rows[2].a}


def test_syncmers_against_brute_force(spark, corpus):
    rows = spark.createDataFrame([(t or "",) for t in corpus], "text string").withColumn("p", fingerprint.pieces(F.col("text"))).withColumn("h", F.transform("p", lambda x: F.xxhash64(x)))
    k, s = fingerprint.K, fingerprint.S
    smers = F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - s, F.lit(0))), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(s)]))
    for r in rows.withColumn("sm", smers).withColumn("a", fingerprint.syncmers(F.col("text"))).collect():
        assert r.p == py_anchors(r.text)
        n = len(r.p)
        if n < k:
            assert [x.at for x in r.a] == ([0] if n else [])
            continue
        want = [i for i in range(n - k + 1) if min(r.sm[i : i + k - s + 1]) in (r.sm[i], r.sm[i + k - s])]
        assert [x.at for x in r.a] == want


def test_no_text_with_a_word_has_an_empty_fingerprint(spark):
    rng = random.Random(21)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))) for _ in range(n)) for n in range(1, 20) for _ in range(30)]
    rows = [(r.text, tuple(x.h for x in r.anchors)) for r in fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert len(rows) == len(texts) and all(a for _, a in rows)
    assert len({a for _, a in rows}) == len({t for t, _ in rows})
    empty = fingerprint.fingerprints(spark.createDataFrame([(1, None), (2, ""), (3, " \t\n")], "doc_id long, text string"))
    assert [r.anchors for r in empty.collect()] == [[]] * 3


def test_near_copies_in_runs_without_blanks_share_anchors(spark):
    rng = random.Random(22)
    runs = ["".join(chr(rng.randrange(low, low + 40)) for _ in range(400)) for low in (0x4E00, 0x3041, 0x30A1, 0x0E01)]
    runs.append("".join(rng.choice("0123456789abcdef") for _ in range(400)))
    for run in runs:
        a, b = (fingerprint.hashes(fingerprint.syncmers(F.col(c))) for c in "ab")
        row = spark.createDataFrame([(run, run[:5] + run[7] + run[5:])], "a string, b string").select(fingerprint.likeness(a, b).alias("x")).first()
        assert row.x > 0.85


def test_op1(spark, corpus, tmp_path):
    ids = random.Random(3).sample(range(10_000), len(corpus))
    got = {r.doc_id: r for r in fingerprint.op1_fingerprints(spark, write_tables(spark, tmp_path, documents=docs(spark, corpus, ids))).collect()}
    order = sorted(zip(ids, [t or "" for t in corpus]))
    assert len(got) == len(order)
    prints = {}
    for i, (d, t) in enumerate(order):
        other_id, other = order[i - 1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + other[:cut]
        a, b, c = (set(x.split()) for x in (got[d].fingerprint, got[d].edited_fingerprint, got[other_id].fingerprint))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), sha(edited))
        assert got[d].near_edited == pytest.approx(like(a, b)) and got[d].near_next == pytest.approx(like(a, c))
        assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_op1_corner_tables(spark, tmp_path):
    assert fingerprint.op1_fingerprints(spark, write_tables(spark, tmp_path / "e", documents=docs(spark, []))).count() == 0
    one = fingerprint.op1_fingerprints(spark, write_tables(spark, tmp_path / "o", documents=docs(spark, ["some words stand here"], [5]))).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = fingerprint.op1_fingerprints(spark, write_tables(spark, tmp_path / "d", documents=docs(spark, ["a b", "a b", "c d", None], [1, 1, None, 2]))).collect()
    assert len(rows) == 4
    none = fingerprint.op1_fingerprints(spark, write_tables(spark, tmp_path / "n", documents=docs(spark, ["a b", "c d"], [None, None]))).collect()
    assert len(none) == 2


def test_shared_anchors(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    a, b = fingerprint.syncmers(F.col("a")), fingerprint.syncmers(F.col("b"))
    row = spark.createDataFrame([(t, "x " + t)], "a string, b string").select(a.alias("a"), b.alias("b")).select(fingerprint.shared_anchors(F.col("a"), F.col("b")).alias("m")).first()
    assert row.m and {x.b - x.a for x in row.m} == {1}


# ---------------------------------------------------------------- 2 BPE


@pytest.fixture(scope="module")
def vocabulary():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    return bpe.Bpe(Path(path).read_text()), Tokenizer.from_file(path)


def unpacked(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_bpe_equals_the_library(vocabulary, corpus):
    own, library = vocabulary
    rng = random.Random(4)
    odd = ["".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(128, 0x2000), 0x4E00 + rng.randrange(99), 0x1F600 + rng.randrange(30), 32, 10])) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts = [t or "" for t in corpus] + odd + ["it's we'll <|endoftext|> x<|endoftext|>", "a" * 3000, "  \n\n  x", "é" * 700]
    for t, p in zip(texts, own.encode_all(texts), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert unpacked(p) == ids and own.decode(ids) == t == library.decode(ids, skip_special_tokens=False)


def test_both_merges_agree(vocabulary):
    own, _ = vocabulary
    rng = random.Random(6)
    for _ in range(300):
        word = bytes(rng.choice(b"abcdeht inrs\xc3\xa9") for _ in range(rng.randrange(1, 60)))
        assert bpe.merge_short(word, own.ranks) == bpe.merge_long(word, own.ranks)
        assert own._merge(word) == own._merge_block([word, b"ab"])[0]


def test_op2(spark, corpus, tmp_path, vocabulary):
    _, library = vocabulary
    rows = bpe.op2_bpe(spark, write_tables(spark, tmp_path, documents=docs(spark, corpus))).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        t = corpus[r.doc_id] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(t))
    assert bpe.op2_bpe(spark, write_tables(spark, tmp_path / "e", documents=docs(spark, []))).count() == 0


# ---------------------------------------------------------------- 3 substring dedup


def brute_substrings(rows, width):
    first = {}
    words = [(d, BLANK.findall(t or "")) for d, t in rows]
    for d, w in sorted(words, key=lambda x: x[0]):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = {}
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("width", [50, 7, 2])
def test_substring_dedup(spark, corpus, width):
    ids = random.Random(width).sample(range(10_000), len(corpus))
    got = {r.id: (r.n_words, r.n_removed, r.sha256) for r in substring_dedup.substring_dedup(docs(spark, corpus, ids), width=width).collect()}
    want = brute_substrings(list(zip(ids, corpus)), width)
    assert got == want and any(v[1] for v in want.values())


def test_substring_dedup_corners(spark, tmp_path):
    assert substring_dedup.op3_substring_dedup(spark, write_tables(spark, tmp_path, documents=docs(spark, []))).count() == 0
    long = " ".join(f"w{i}" for i in range(80))
    rows = substring_dedup.substring_dedup(docs(spark, [long, long, long, None], [None, 3, 3, 4])).collect()
    assert sorted((r.id is None, r.n_removed) for r in rows) == [(False, 0), (False, 0), (False, 0), (True, 0)]


# ---------------------------------------------------------------- 4 chat


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, idx string")


def chat_rows():
    rng = random.Random(7)
    rows = []
    for c in range(12):
        n = rng.choice([1, 2, 3, 9, 60])
        for t in range(n):
            role = "system" if t == 0 and c % 2 else ["user", "assistant", 'odd"<role\\'][t % 2 if rng.random() < 0.9 else 2]
            text = rng.choice(["", "short", "\\l <turn> \\b\\", '</turn>\n<turn role="assistant" again="0">x', "word " * rng.randrange(1, 700)])
            rows.append((c, t, role, text))
    return rows + [(50, 0, "system", "only")]


def test_op4_reads_back_everything(spark, tmp_path):
    rows = chat_rows()
    got = {r.conv_id: r for r in chat.op4_chat(spark, write_tables(spark, tmp_path, conversations=conversations(spark, rows + [(60, 1, None, None), (60, None, "user", "first")]))).collect()}
    odd = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd), (60, -1, "user", "first"), (60, 1, "", "")]
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_windows_keep_the_budget(spark):
    found = chat.windows(conversations(spark, chat_rows()), budget=300, history=60).collect()
    dearest = {}
    for w in found:
        turns = re.findall(chat._TURN, w.formatted)
        assert "".join(f'<turn role="{r}" again="{a}">{x}</turn>\n' for r, a, x in turns) == w.formatted
        fresh = [t for t in turns if t[1] == "0" and not (t[0] == "system")]
        assert w.n_tokens <= 300 or len(fresh) <= 1
        dearest.setdefault(w.conv_id, []).append(turns)
        assert [w.formatted[s.start : s.end] for s in w.loss] == [x for r, a, x in turns if r == "assistant" and a == "0"]
    many = [t for t in dearest.values() if len(t) > 2 and t[0][0][0] == "system"]
    assert many and all(w[0][0] == "system" for t in many for w in t)
    assert any(a == "1" and r != "system" for t in dearest.values() for w in t for r, a, _ in w)


def test_chat_blocks_and_empty(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t}") for t in range(2500)]
    found = sorted(chat.windows(conversations(spark, rows)).collect(), key=lambda w: w.window)
    seen = [x for w in found for r, a, x in re.findall(chat._TURN, w.formatted) if a == "0"]
    assert seen == [f"text {t}" for t in range(2500)]
    assert chat.windows(conversations(spark, [])).count() == 0


# ---------------------------------------------------------------- 5 lines


def test_line_dedup(spark):
    every = [(i, f"own line {i}\n  shared foot \nmore {i}\n\nnear miss" if i < 9 else f"own line {i}\nshared foot\r\nmore {i}", None, f"s{i % 40}") for i in range(60)]
    copies = [(100 + i, "copied text one\ncopied text two", None, f"s{i}") for i in range(15)]
    rows = every + copies + [(200, None, None, "s1"), (201, "", None, None), (202, "shared foot", None, "s1")]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, gone int")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df, min_sites=10).collect()}
    assert got[0].__getitem__("__text") == "own line 0\nmore 0\n\nnear miss" and got[0]["__n_removed"] == 1 and got[0]["__n_lines"] == 4
    assert got[20]["__text"] == "own line 20\nmore 20"
    assert got[100]["__whole"] and got[100]["__text"] == "copied text one\ncopied text two"
    assert got[200]["__text"] is None and got[201]["__text"] == ""
    assert got[202]["__text"] == "" and not got[202]["__whole"]  # boilerplate alone, but its text is on one site


def test_stages_take_columns_of_any_name(spark, tmp_path):
    names = ["__text", "__n_lines", "__n_removed", "__whole", "__lang", "__score", "__rejected", "__gone", "__hit", "__own", "__id", "gone", "hit_id", "hit_key", "own_hash", "rejected", "LANG_FOUND", "n_lines", "text_left", "component", "h"]
    rows = spark.createDataFrame([(i, f"menu of all\ntext number {i} of its own kind", "en", f"s{i}", 9) for i in range(12)] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = rows.withColumns({n: F.lit(7) for n in names})
    folder = write_tables(spark, tmp_path, documents=rows, benchmark=spark.createDataFrame([(1, "number 3")], "item_id long, text string"))
    for stage, n in ((language_id.accepted, 12), (line_dedup.without_boilerplate, 13), (near_duplicates.one_of_each, 13), (decontaminate.clean, 12)):
        left = stage(spark, rows, folder)
        assert left.columns == rows.columns and left.count() == n
        assert all(r[c] == 7 for r in left.collect() for c in names)
    assert {r.text for r in line_dedup.without_boilerplate(spark, rows, folder).collect()} == {None, *(f"text number {i} of its own kind" for i in range(12))}


def test_op5_corners(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    none = write_tables(spark, tmp_path / "e", documents=spark.createDataFrame([], schema))
    assert line_dedup.op5_line_dedup(spark, none).count() == 0
    rows = [(None, "foot\nmine", f"s{i}") for i in range(9)] + [(5, "foot\nmine", "s1"), (5, "foot\nmine", "s1"), (5, "foot\nother", "t9"), (6, "foot\n" + "y" * (3 << 20), "s2")]
    got = line_dedup.op5_line_dedup(spark, write_tables(spark, tmp_path, documents=spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.kept_sha256) for r in got) == sorted([(0, 1, sha("mine"))] * 9 + [(5, 1, sha("mine"))] * 2 + [(5, 1, sha("other")), (6, 1, sha("y" * (3 << 20)))])


def test_line_counts_are_exact_at_the_threshold(spark):
    rows = [(s * 100 + k, f"line {s}\nunique {s} {k} with more text beside it", None, f"site{k}", 0) for s in range(5, 15) for k in range(s)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = line_dedup.line_dedup(df, min_sites=10).groupBy(F.floor(F.col("doc_id") / 100).alias("s")).agg(F.sum("__n_removed").alias("n")).collect()
    assert {r.s: r.n > 0 for r in got} == {s: s >= 10 for s in range(5, 15)}


def test_only_proven_copies_are_left_whole(spark):
    rows = [(i, f"menu of all sites\nown {i}", None, f"s{i}") for i in range(12)]  # mostly boilerplate, each text on one site
    rows += [(100 + i, "copied text one\ncopied text two", None, f"s{i}") for i in range(10)]
    rows += [(200, "copied text one\ncopied text two\nmine", None, "s1"), (201, "menu of all sites", None, "s1"), (202, None, None, "s1"), (203, "own\nmenu of all sites\n", None, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.without_boilerplate(spark, df, "").collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (f"own {i}", len(f"own {i}")) for i in range(12))
    assert all(got[100 + i] == ("copied text one\ncopied text two", 7) for i in range(10))
    assert (got[200], got[201], got[202], got[203]) == (("mine", 4), ("", 0), (None, 7), ("own\n", 4))


# ---------------------------------------------------------------- 6 WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, size int")


def brute_pages(rows):
    first = {}
    for p, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", p)
    import base64

    out = {}
    for p, _, h in rows:
        raw, one = (h or "").encode(), first[h or ""]
        out[p] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if one == p else "revisit", None if one == p else one)
    return out


def test_op6(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"http://x.example/{i}\r\nX-Evil: 1" if i % 9 == 0 else None if i % 9 == 1 else f"http://é.example/{i}", rng.choice([None, "", f"<p>{i}</p>" * 50, "same page", "é\r\n\r\nWARC/1.1\r\n", "big" * 5000])) for i in range(200)]
    got = {r.page_id: tuple(r)[1:] for r in warc.op6_warc(spark, write_tables(spark, tmp_path, pages=pages(spark, rows))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    assert got == brute_pages(rows)
    assert warc.op6_warc(spark, write_tables(spark, tmp_path / "e", pages=pages(spark, []))).count() == 0
    twice = warc.op6_warc(spark, write_tables(spark, tmp_path / "t", pages=pages(spark, [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, "u", "b"), (None, "u", "a")]))).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in twice) == [(0, "response"), (0, "revisit"), (1, "response"), (1, "response"), (2, "revisit")]


def test_archives_have_a_dictionary_and_single_records(tmp_path):
    import zstandard

    w = warc.Writer(f"file://{tmp_path}")
    raws = [warc.record(i, f"http://x/{i}", (f"<html><body><p>page {i} of the same site, with the same words</p></body></html>" * 20).encode(), None) for i in range(300)]
    for r in raws:
        w.add(r)
    (path, n), = w.close()
    data = Path(path).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert n == 300 and magic == 0x184D2A5D and size > 0 and struct.unpack("<I", data[8:12])[0] == warc.RAW_DICTIONARY_MAGIC
    assert list(warc.read(f"file://{tmp_path}", path)) == raws
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(data[8 + size :])
    assert one == raws[0]
    assert len(data) < sum(len(zstandard.compress(r)) for r in raws)


@pytest.mark.parametrize(("n", "size"), [(5, 4_000), (15, 300_000), (1, 60_000)])
def test_few_or_large_records_have_a_dictionary(tmp_path, n, size):
    rng = random.Random(n)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    raws = [warc.record(i, f"http://x/{i}", " ".join(rng.choice(words) for _ in range(size // 7)).encode(), None) for i in range(n)]
    w = warc.Writer(f"file://{tmp_path}")
    for r in raws:
        w.add(r)
    (path, _), = w.close()
    magic, length = struct.unpack("<II", Path(path).read_bytes()[:8])
    assert magic == warc.DICTIONARY_MAGIC and length > 0
    assert list(warc.read(f"file://{tmp_path}", path)) == raws


# ---------------------------------------------------------------- 7 language


def speech(rng, lang):
    syllables = {"aa": ["ka", "ko", "ti", "mu"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["éau", "ois", "que", "ent"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 80)))


def test_language_held_out(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, speech(rng, lang := rng.choice(["aa", "bb", "cc"])), lang if i % 10 else None) for i in range(900)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 -- !!", "bb"), (1003, "漢字かな", None)]
    df = spark.createDataFrame([(*r, "s", len(r[1] or ""), 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")
    folder = write_tables(spark, tmp_path, documents=df)
    got = {r.doc_id: r for r in language_id.op7_language_id(spark, folder).collect()}
    held = [(got[d].lang_pred, lang) for d, _, lang in rows if d < 1000 and lang and zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= got[d].score <= 1 for d in got)
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in {"aa", "bb", "cc"}
    kept = language_id.accepted(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert kept.columns == df.columns and not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()} and kept.count() >= 895
    assert language_id.op7_language_id(spark, write_tables(spark, tmp_path / "e", documents=df.limit(0))).count() == 0
    unlabelled = language_id.op7_language_id(spark, write_tables(spark, tmp_path / "u", documents=df.withColumn("lang", F.lit(None).cast("string")))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in unlabelled] == ["und"]


def test_every_language_is_in_the_sample_and_learned(spark):
    rows = [(i, f"text {i}", f"l{i % 300:03}") for i in range(900)] + [(1000 + i, "langer satz " * 3000, "long") for i in range(3)] + [(2000, "nur einmal hier", "once")]
    some = language_id.sample(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert {v for _, v in some} == {r[2] for r in rows} and sum(len(t) for t, _ in some) <= language_id.SAMPLE * language_id.LONGEST
    for seed in range(12):
        m = language_id.train(["kako tikomu"] * 20 + ["schein verung"], ["aa"] * 20 + ["bb"], seed)
        assert m.scores(pa.array(["schein verung"]))[0].argmax() == 1


def test_scores_do_not_depend_on_how_rows_are_stored(spark, tmp_path):
    rng = random.Random(12)
    rows = spark.createDataFrame([(i, speech(rng, lang := rng.choice(["aa", "bb", "cc"])), lang) for i in range(300)], "doc_id long, text string, lang string")
    scores = []
    for k, some in enumerate((rows.orderBy("doc_id").coalesce(1), rows.repartition(5, "text"))):
        folder = write_tables(spark, tmp_path / str(k), documents=some)
        scores.append({r.doc_id: (r.lang_pred, r.score) for r in language_id.op7_language_id(spark, folder).collect()})
    assert scores[0] == scores[1]


def test_a_prediction_depends_on_its_text_alone():
    m = language_id.train(["kako tikomu"] * 20 + ["schein verung"] * 20, ["aa"] * 20 + ["bb"] * 20)
    many = m.scores(pa.array(["kako", "schein ung", "", "mukati"]))
    for i, t in enumerate(["kako", "schein ung", "", "mukati"]):
        assert m.scores(pa.array([t]))[0] == pytest.approx(many[i])


# ---------------------------------------------------------------- 8 near-duplicates


def brute_groups(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = BLANK.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_superminhash_rounds():
    rng = np.random.default_rng(1)
    value = rng.integers(0, 1 << 63, 43).astype(np.uint64)
    row = np.array([0] * 40 + [1] * 3)
    sig = near_duplicates.signatures(row, value, 3, 32)
    for r in (0, 1):
        want = [None] * 32
        for v in value[row == r]:
            order = list(range(32))
            for k in range(32):
                to, offer = near_duplicates._offers(np.array([v]), k, 32)
                order[k], order[to[0]] = order[to[0]], order[k]
                if want[order[k]] is None or int(offer[0]) < want[order[k]]:
                    want[order[k]] = int(offer[0])
        assert sig[r].tolist() == want
    assert (sig[2] == near_duplicates._NO_OFFER).all()


def test_signatures_do_not_depend_on_the_block(monkeypatch):
    rng = np.random.default_rng(3)
    row = np.repeat(np.arange(40), rng.integers(1, 120, 40))
    value = rng.integers(0, 1 << 63, len(row)).astype(np.uint64)
    whole = near_duplicates.signatures(row, value, 41)
    for block in (1, 50, 64, 333):
        monkeypatch.setattr(near_duplicates, "_BLOCK", block)
        assert (near_duplicates.signatures(row, value, 41) == whole).all()


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 100, 100))
    sig = near_duplicates.signatures(np.repeat([0, 1], 700), np.concatenate([common, a, common, b]), 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - 600 / 800) < 0.05


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80), (2, 60)])
def test_near_duplicates(spark, corpus, k, percent):
    ids = random.Random(k).sample(range(10_000), len(corpus))
    got = {r.id: (r.n_shingles, r.component) for r in near_duplicates.near_duplicates(docs(spark, corpus, ids), shingle=k, percent=percent).collect()}
    want = brute_groups(list(zip(ids, corpus)), k, percent)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_a_large_group_with_distant_copies(spark):
    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(300):
        v = list(base)
        for j in rng.sample(range(150), rng.randrange(9)):
            v[j] = rng.choice(["pool1", "pool2", f"new{i}{j}"])
        texts.append(" ".join(v))
    got = {r.id: (r.n_shingles, r.component) for r in near_duplicates.near_duplicates(docs(spark, texts), shingle=4).collect()}
    assert got == brute_groups(list(enumerate(texts)), 4, 80)


def test_a_large_group_of_families_against_brute_force(spark):
    """Near and distant copies of one text, copies of these, and pieces of it, by five-word shingles."""
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]

    def edited(v, n):
        v = list(v)
        for j in rng.sample(range(len(v)), min(n, len(v))):
            v[j] = rng.choice(["pool", f"new{rng.randrange(10**6)}"])
        return v

    made = [edited(base, rng.randrange(3)) for _ in range(900)] + [edited(base, rng.randrange(3, 7)) for _ in range(500)]
    made += [edited(rng.choice(made[900:]), rng.randrange(1, 3)) for _ in range(400)]
    made += [base[(a := rng.randrange(60)) : a + rng.randrange(40, 60)] + ["tail"] * rng.randrange(2) for _ in range(200)]
    texts = [" ".join(v) for v in made]
    sets = [{tuple(v[i : i + 5]) for i in range(max(1, len(v) - 4))} for v in made]
    number: dict = {}
    for one in sets:
        for x in one:
            number.setdefault(x, len(number))
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, one in enumerate(sets):
        has[i, [number[x] for x in one]] = 1
    both, sizes = has @ has.T, has.sum(axis=1)
    linked = 100 * both >= 80 * (sizes[:, None] + sizes[None, :] - both)
    label = np.arange(len(sets))
    while True:
        low = np.where(linked, label[None, :], len(sets)).min(axis=1)
        if (low == label).all():
            break
        label = low
    got = {r.id: r.component for r in near_duplicates.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == label.tolist() and len(set(label.tolist())) > 100


def test_near_duplicate_corners(spark, tmp_path):
    assert near_duplicates.op8_near_duplicates(spark, write_tables(spark, tmp_path, documents=docs(spark, []))).count() == 0
    rows = near_duplicates.near_duplicates(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [4, 4, None, 9])).collect()
    assert sorted((r.id or 0, r.component or 0) for r in rows) == [(0, 0), (4, 4), (4, 4), (9, 9)]
    kept = near_duplicates.one_of_each(spark, docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [4, 7, None, 9]), "")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 9] and kept.columns[:2] == ["doc_id", "text"]


def test_components(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}


# ---------------------------------------------------------------- 9 decontamination


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items, width=10):
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = {}
    for d, t in texts:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, ids = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit[j : j + n] = [True] * n
                    ids |= windows[tuple(w[j : j + n])]
        out[d] = (len(w), sum(hit), len(ids), sha(",".join(sorted(map(str, ids)))), any(hit))
    return out


def benchmark_case(corpus):
    items = [(i, t) for i, t in enumerate(sentences(20, 30)) if t] + [(90, "two words"), (91, None), (92, "!!"), (93, "Solo-9"), (100, "two words")]
    rng = random.Random(12)
    texts = list(corpus)
    for _, t in items[:12]:
        texts.append("Before, " + t.upper().replace(" ", " -- ") + "; after")
        w = t.split()
        texts.append(" ".join(w[: rng.randrange(len(w) + 1)]) + " cut " + " ".join(w[-11:]))
    return [*texts, "it has TWO... words, solo 9"], items


@pytest.mark.parametrize("shard", [None, 400])
def test_op9(spark, corpus, tmp_path, monkeypatch, shard):
    texts, items = benchmark_case(corpus)
    if shard:
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n_words int")
    got = decontaminate.op9_decontaminate(spark, write_tables(spark, tmp_path, documents=docs(spark, texts), benchmark=bench)).collect()
    want = brute_hits(list(enumerate(texts)), items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want and any(v[4] for v in want.values())
    for r in decontaminate.decontaminate(docs(spark, texts), bench).collect():
        said = [x for s in r.spans for x in ALNUM.findall(texts[r.id][s.first : s.end].translate(LOWER))]
        assert len(said) == r.n_hit or shard


@pytest.mark.parametrize("shard", [None, 20])
def test_items_without_an_id_hit(spark, tmp_path, monkeypatch, shard):
    if shard:
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    bench = spark.createDataFrame([(None, "no id here"), (3, "named item text"), (None, None)], "item_id long, text string")
    texts = ["x no id here y", "named item text", "named item text no id here", "clean"]
    folder = write_tables(spark, tmp_path, documents=docs(spark, texts), benchmark=bench)
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op9_decontaminate(spark, folder).collect()}
    assert got == {0: (3, 0, sha(""), True), 1: (3, 1, sha("3"), True), 2: (6, 1, sha("3"), True), 3: (0, 0, sha(""), False)}
    assert [r.doc_id for r in decontaminate.clean(spark, docs(spark, texts), folder).collect()] == [3]


@pytest.mark.parametrize("raws", [[b"x"], [b"a" * 100_000], [b"", b"y" * 5], [bytes([i]) * 9000 for i in range(20)]])
def test_every_archive_has_a_dictionary(tmp_path, raws):
    w = warc.Writer(f"file://{tmp_path}")
    for r in raws:
        w.add(r)
    (path, n), = w.close()
    assert n == len(raws) and list(warc.read(f"file://{tmp_path}", path)) == raws
    assert struct.unpack("<I", Path(path).read_bytes()[8:12])[0] == warc.RAW_DICTIONARY_MAGIC


def test_the_dictionary_is_of_the_whole_archive():
    records = [bytes([i % 251]) * 1000 for i in range(30_000)]
    some = warc._spread(records)
    assert records.index(some[-1]) >= 0 and some == records[:: 30_000_000 // warc.SAMPLE_BYTES + 1]


@pytest.mark.parametrize("shard", [None, 20])
def test_rows_that_share_an_id_or_have_none(spark, tmp_path, monkeypatch, shard):
    if shard:
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    bench = spark.createDataFrame([(1, "first item text"), (2, "second item text"), (2, "third item text"), (None, "no id here")], "item_id long, text string")
    texts = ["x first item text", "clean", "second item text third item text first item text", "clean", "no id here", "no id here", None]
    ids = [7, 7, None, None, 7, 7, None]
    folder = write_tables(spark, tmp_path, documents=docs(spark, texts, ids), benchmark=bench)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.op9_decontaminate(spark, folder).collect())
    assert got == sorted([(7, 4, 3, 1), (7, 1, 0, 0), (0, 9, 9, 2), (0, 1, 0, 0), (7, 3, 3, 0), (7, 3, 3, 0), (0, 0, 0, 0)])
    left = decontaminate.clean(spark, docs(spark, texts, ids), folder).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, "clean"), (7, "clean")]


def test_op9_empty_tables(spark, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    folder = write_tables(spark, tmp_path, documents=docs(spark, ["a b c"]), benchmark=bench)
    assert [r.contaminated for r in decontaminate.op9_decontaminate(spark, folder).collect()] == [False]
    folder = write_tables(spark, tmp_path / "e", documents=docs(spark, []), benchmark=spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert decontaminate.op9_decontaminate(spark, folder).count() == 0


# ---------------------------------------------------------------- 10 quality


def test_quality_held_out(spark, tmp_path):
    rng = random.Random(13)
    clean = sentences(30, 900)
    rows, labels = [], []
    for i, t in enumerate(clean):
        good = rng.random() < 0.8
        text = t.capitalize() + "." if good else rng.choice([" | ".join(t.split()), " ".join(f"{w}###" for w in t.split()), (t.split()[0] + " ") * 40])
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(good), 0))
    folder = write_tables(spark, tmp_path, documents=docs(spark, [t for _, t in rows] + [None, ""], [i for i, _ in rows] + [5000, 5001]), labels=spark.createDataFrame(labels + [(7777, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.op10_quality(spark, folder).collect()}
    assert len(got) == len(rows) + 2
    held = [(got[d].score, q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_the_prior_is_estimated_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.85):
        n = int(2000 * share)
        unl = np.concatenate([rng.normal(0, 1, (n, 3)), rng.normal(5, 1, (2000 - n, 3))])
        assert abs(quality.train(rng.normal(0, 1, (1500, 3)), unl).prior - share) < 0.08


def test_labels_of_zero_are_not_learned_from(spark, tmp_path):
    texts = [t.capitalize() + "." if i % 4 else " | ".join(t.split()) for i, t in enumerate(sentences(31, 300))]
    scores = []
    for k, zeros in enumerate(([], [(i, 0, 0) for i in range(0, 300, 4)])):
        labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 300, 4)] + zeros, "doc_id long, quality int, toxic int")
        folder = write_tables(spark, tmp_path / str(k), documents=docs(spark, texts), labels=labels)
        scores.append({r.doc_id: r.score for r in quality.op10_quality(spark, folder).collect()})
    assert scores[0] == scores[1]


def test_quality_corners(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = write_tables(spark, tmp_path, documents=docs(spark, ["a", None]), labels=empty)
    assert [r.score for r in quality.op10_quality(spark, folder).collect()] == [0.5, 0.5]
    folder = write_tables(spark, tmp_path / "e", documents=docs(spark, []), labels=spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert quality.op10_quality(spark, folder).count() == 0
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(0, 1, (400, 3)), np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(6, 1, (100, 3))])
    m = quality.train(pos, unl, None)
    assert 0.5 <= m.prior <= 0.95 and m.score(rng.normal(6, 1, (50, 3))).mean() < m.score(rng.normal(0, 1, (50, 3))).mean()


def test_a_score_depends_on_its_text_alone():
    texts = ["One line. Two!", "", None, "A | B | C", "rep rep rep"]
    whole = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert quality.features(pa.array([t], pa.string()))[0] == pytest.approx(whole[i])


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, corpus, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts, items = benchmark_case(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    folder = write_tables(spark, tmp_path, documents=docs(spark, texts).withColumn("lang", F.lit("en")), benchmark=bench)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    left = {i: t for i, t in enumerate(texts) if language_id.has_letter(t)}
    groups = brute_groups(list(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    hits = brute_hits(list(left.items()), items)
    want = {i for i in left if not hits[i][4]}
    assert {r.doc_id for r in rows} == want
    assert all(r.decoded_sha256 == sha(texts[r.doc_id]) and len(r.tokens) == r.n_tokens for r in rows)


def test_pipeline_with_boilerplate(spark, corpus, tmp_path):
    """A line on 12 sites goes from every text, and what it held apart becomes a copy."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    own = [t for t in sentences(40, 40) if len(t.split()) > 8][:24]
    texts = [f"Accept all cookies\n{t}\n\tAccept all cookies " if i % 2 else t for i, t in enumerate(own)] + [f"{own[0]}\nAccept all cookies"]
    rows = spark.createDataFrame([(i, t, "en", f"s{i}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = write_tables(spark, tmp_path, documents=rows, benchmark=spark.createDataFrame([], "item_id long, text string"))
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: sha(t) for i, t in enumerate(own)}


def test_pipeline_on_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = write_tables(spark, tmp_path, documents=docs(spark, []), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_queries_are_listed():
    from millrace.llm import queries

    names = list(queries.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
    assert json.dumps(names)
