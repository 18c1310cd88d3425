"""The ten operators against brute force, round trips and their libraries, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moderix.llm import chat, decontaminate, jaccard_join, language_id, lm_scoring, media, op2, op4, op9, pii, piece_bpe, stages, textvec, token_counts, toxicity

WORDS = [f"w{i}" for i in range(400)]
DOC = "doc_id long, text string"


def frame(spark, texts: list, extra: bool = False):  # noqa: ANN201
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    return df.withColumn("keys", F.lit(1)).withColumn("size", F.lit("x")).withColumn("_old0", F.lit(2)) if extra else df


def some_texts(n: int, seed: int = 1, length: tuple[int, int] = (0, 60)) -> list:
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(*length))) for _ in range(n)]


# -- words and components -------------------------------------------------------------------------------------------

def shingle_set(text: str | None, n: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def test_shingles_of_odd_texts() -> None:
    texts = ["", None, "a", "A a", "a b c d e", " x\ty\nz  ", "é É ü", "x" * 3_000_000 + " y", "a " * 1000, " nbsp "]
    got = [n for w in textvec.pieces(pa.array(texts)) for n in np.diff(textvec.shingle_sets(w, 4)[0]).tolist()]
    assert got == [len(shingle_set(t, 4)) for t in texts]


def test_components(spark) -> None:
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)]
    got = {r.node: r.component for r in stages.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in got.items()} == {k: root[k] for k in got}
    assert {x for a, b in edges if a != b for x in (a, b)} == set(got)


def test_tables_between_steps(spark, monkeypatch) -> None:
    import os

    df = stages.written(spark.range(5), "kept")
    path = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(path) and df.count() == 5
    stages.dropped(df)
    assert not os.path.exists(path)

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError):
        stages.shared_dir(Cluster)


# -- 8 ----------------------------------------------------------------------------------------------------------------

def brute(texts: list, n: int, num: int, den: int) -> dict:
    sets = [shingle_set(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(n: int, seed: int, words: int = 80, edits: int = 5) -> list[str]:
    """Copies of one text with some words changed: close to the threshold, so that not all pairs link."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_jaccard_components(spark, n: int, num: int, den: int) -> None:
    texts = some_texts(60) + near_copies(420, 5) + near_copies(40, 6, 18, 2) + near_copies(30, 7, 300, 30) + ["a b", "A B", "a b c", None, "", " "] + ["same text here " * 9] * 300
    random.Random(9).shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(frame(spark, texts, True), n, num, den).collect()}
    assert got == brute(texts, n, num, den)


def test_small_sets_share_subsets() -> None:
    t = jaccard_join.Threshold(85, 100)
    rng = np.random.default_rng(0)
    for a in range(1, 22):
        h = np.unique(rng.integers(0, 1 << 62, a)).astype(np.uint64)
        for lost in range(a - t.least(a) + 1):
            other = h[lost:]
            assert t.links(len(h), len(other), len(other)) == bool(len(np.intersect1d(jaccard_join.subset_keys(h, t), jaccard_join.subset_keys(other, t))))


def test_jaccard_of_nothing_and_null_ids(spark) -> None:
    assert jaccard_join.components(frame(spark, []), 5, 80, 100).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], DOC)
    assert sorted(((r.doc_id, r.component_id) for r in jaccard_join.components(rows).collect()), key=str) == [(1, 1), (1, 1), (None, None)]
    kept = jaccard_join.deduplicated(rows)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_texts_are_shuffled_compressed(spark) -> None:
    """What meets in joins is compressed; the rows come back as they were, other columns and null texts too."""
    text = "Çok güzel, “naïve” \u0000 \U0001f600 " * 20
    rows = [(1, text, "a"), (2, text, "b"), (2, None, "c"), (2, "", "d"), (3, "x " * 50, "e"), (3, "x " * 50, "e"), (None, text, "f"), (None, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `more.of it` string")
    out = jaccard_join.deduplicated(docs)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([r for i, r in enumerate(rows) if i not in (1, 5)], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unzip_text" in plan and plan.count("zip_text") > plan.count("unzip_text")
    own = docs.select("text", stages.zipped(F.col("text")).alias("z")).select("text", stages.unzipped(F.col("z")).alias("again"), F.length("z").alias("n"))
    assert all(r.text == r.again and (r.text is None or len(r.text) < 50 or r.n < len(r.text) / 2) for r in own.collect())


def test_jaccard_first_copy_without_an_id(spark) -> None:
    text = " ".join(WORDS[:60])
    rows = spark.createDataFrame([(None, text), (4, text), (2, text), (1, text + " more"), (7, "a b c d e f")], DOC).coalesce(1)
    assert sorted(((r.doc_id, r.component_id) for r in jaccard_join.components(rows).collect()), key=str) == [(1, 1), (2, 1), (4, 1), (7, 7), (None, None)]
    assert sorted(str(r.doc_id) for r in jaccard_join.deduplicated(rows).collect()) == ["1", "7", "None"]


def test_jaccard_repeated_ids_with_other_texts(spark) -> None:
    one, two, three = (" ".join(WORDS[a : a + 60]) for a in (0, 100, 200))
    rows = [(5, one), (5, two), (5, two), (3, two + " more"), (9, one), (7, three), (7, three), (8, None), (8, ""), (2, " ")]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, _id string, s1 int").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(df).collect())
    assert got == sorted([(5, 56, 5), (5, 56, 3), (5, 56, 3), (3, 57, 3), (9, 56, 5), (7, 56, 7), (7, 56, 7), (8, 0, 8), (8, 0, 8), (2, 0, 2)])
    kept = jaccard_join.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(5, one), (3, two + " more"), (7, three), (8, ""), (8, ""), (2, " ")])


def test_packed_postings() -> None:
    rng = np.random.default_rng(4)
    for n in (1, 3, 2000):
        key = np.sort(rng.integers(0, 1 << 48, n).astype(np.uint64))
        ref, size = rng.integers(0, 1 << 40, n), rng.integers(0, 70_000, n)
        for a, b in zip(jaccard_join.unpacked(jaccard_join.packed(key, ref, size)), (key, ref, size), strict=True):
            assert a.tolist() == b.tolist()


@pytest.mark.parametrize("setting", ["HOT", "LOCAL", "FLUSH", "PER_RANGE", "PER_BLOCK"])
def test_jaccard_bounds_change_nothing(spark, monkeypatch, setting: str) -> None:
    monkeypatch.setattr(jaccard_join, setting, 3)
    monkeypatch.setattr(jaccard_join, "SHORT", 4)
    texts = near_copies(40, 5) + near_copies(12, 6, 18, 2) + some_texts(20) + ["a b", "A B", None] + ["same text here " * 9] * 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(frame(spark, texts)).collect()}
    assert got == brute(texts, 5, 80, 100)


# -- 9 ----------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def bpe() -> piece_bpe.PieceBpe:
    with open(op9.model_path(), "rb") as f:
        return piece_bpe.PieceBpe(f.read())


def test_agenda_is_the_library(bpe) -> None:
    rng = random.Random(1)
    alphabet = [*"aethno \n\t▁.,!0é漢😀̀\x00\r", "  ", "the ", "ing"]
    texts = ["", None, " ", "\n", "  a", "a" * 5000, "▁▁ x", "hello  world"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids = bpe.encode_batch(texts, whole_check=True)
    assert [x.tolist() for x in ids] == bpe.library.encode([t or "" for t in texts])
    assert bpe.decode_batch(ids) == bpe.library.decode([x.tolist() for x in ids])
    assert bpe.joined(np.array([3, 17, 31999], "<u2")) == b"3,17,31999"


def test_small_cache_changes_nothing(bpe, monkeypatch) -> None:
    texts = some_texts(50, 4)
    want = [x.tolist() for x in bpe.encode_batch(texts)]
    monkeypatch.setattr(bpe, "cache", {})
    monkeypatch.setattr(bpe, "old", {})
    monkeypatch.setattr(bpe, "limit", 30)
    assert [x.tolist() for x in bpe.encode_batch(texts)] == want


def test_sentencepiece_frames(spark) -> None:
    rows = frame(spark, ["Hello, world", None, ""], True)
    e = piece_bpe.encode(rows, op9.model_path())
    assert [r.text for r in piece_bpe.decode(e, op9.model_path()).orderBy("doc_id").collect()] == ["Hello, world", "", ""]
    r = piece_bpe.round_trip(rows, op9.model_path()).orderBy("doc_id").collect()
    assert [x.n_tokens for x in r][1:] == [0, 0] and r[1].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_sentencepiece_of_repeated_and_no_rows(spark) -> None:
    rows = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, "c", 0)], "doc_id long, text string, n_tokens int")
    got = piece_bpe.round_trip(rows, op9.model_path()).collect()
    assert len(got) == 3 and got[0] == got[1] and piece_bpe.round_trip(rows.limit(0), op9.model_path()).count() == 0
    assert piece_bpe.decode(piece_bpe.encode(rows.limit(0), op9.model_path()), op9.model_path()).count() == 0


# -- 2 ----------------------------------------------------------------------------------------------------------------

def test_png_round_trip_and_filters() -> None:
    data = media.padded(bytes(range(256)) * 5)
    assert len(data) % 576 == 0 and media.padded(b"") == b"\xff" * 576
    assert media.unpng(media.png(data))[2] == data
    lines = np.frombuffer(data, np.uint8).reshape(-1, media.WIDTH).astype(int)
    up = np.vstack([np.zeros((1, media.WIDTH), int), lines[:-1]])
    left = np.hstack([np.zeros((len(lines), 1), int), lines[:, :-1]])
    corner = np.hstack([np.zeros((len(lines), 1), int), up[:, :-1]])
    guess = left + up - corner
    near = np.stack([abs(guess - left), abs(guess - up), abs(guess - corner)]).argmin(axis=0)
    for kind, minus in enumerate([0 * up, left, up, (left + up) // 2, np.choose(near, [left, up, corner])]):
        raw = np.hstack([np.full((len(lines), 1), kind), (lines - minus) % 256]).astype(np.uint8).tobytes()
        head = media.struct.pack(">IIBBBBB", media.WIDTH, len(lines), 8, 0, 0, 0, 0)
        stored = media.MAGIC + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(raw)) + media._chunk(b"IEND", b"")
        assert media.unpng(stored)[2] == data, kind
    with pytest.raises(ValueError):
        media.unpng(media.png(data)[:-6] + b"\0" * 6)


def test_sequences_keep_order_and_captions(spark) -> None:
    html = "<p>one</p><figure><img src='sha256:aa' alt='x'><figcaption>cap &amp; it</figcaption></figure>two<img src=b alt=y><script>no</script>"
    got = [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.parsed(html)]
    assert got == [("text", "one", None), ("media", "sha256:aa", "cap & it"), ("text", "two", None), ("media", "b", "y")]
    assert media.parsed(None) == []
    rows = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    known = spark.createDataFrame([("aa", 5)], "digest string, n int")
    out = media.resolve(media.sequences(rows), known).orderBy("pos").collect()
    assert [(r.pos, r.caption, r.n) for r in out] == [(1, "cap & it", 5), (3, "y", None)]


def test_media_query(spark, tmp_path) -> None:
    texts = ["abc", None, "", "é" * 400, "abc"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in op2.op2_media_columns(spark, str(tmp_path)).collect():
        data = (texts[r.doc_id] or "").encode()
        p = media.padded(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_malformed_pages(spark) -> None:
    kinds = lambda html: [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.parsed(html)]
    assert kinds("<figure><figcaption>x</figure></figcaption>") == [("text", "x", None)]
    assert kinds("a<![foo[bar]]>b") == [("text", "ab", None)] or kinds("a<![foo[bar]]>b")[0][1].startswith("a")
    assert kinds("<figure><img src=q><figcaption>open") == [("media", "q", "open")]
    assert kinds("<figcaption>lone</figcaption></figure>") == [("text", "lone", None)]
    rng = random.Random(3)
    parts = ["<figure>", "</figure>", "<figcaption>", "</figcaption>", "<img src=a alt=b>", "<video src='v'/>", "<![foo[", "]]>", "<!x", "<!doctype", "<?", ">", "<", "&#x;", "&#99999999;", "t", "<script>", "</script>", "\0", "<![if", "<!--", "--!>"]
    for _ in range(5000):
        items = media.parsed("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))))
        assert [x["pos"] for x in items] == list(range(len(items))) and all((x["kind"] == "text") == (x["ref"] is None) for x in items)


def test_sequences_against_brute_force(spark) -> None:
    """Pages built from known items, some broken off, with repeated pages and digests, against what they were built from."""
    rng = random.Random(13)
    rows, want = [], {}
    for k in range(60):
        parts, items = [], []
        for _ in range(rng.randint(0, 12)):
            kind = rng.choice(["p", "img", "figure"])
            word = f"{rng.choice(WORDS)} é {rng.randrange(99)}"
            if kind == "p":
                parts.append(f"<p>{word}</p><img alt='no source'><script>var x = '<p>';</script>")
                items.append(("text", word, None, None))
            else:
                ref = f"sha256:{rng.randrange(9)}"
                parts.append(f"<img src='{ref}' alt=\"{word}\">" if kind == "img" else f"<figure><img src='{ref}'><figcaption>{word}</figcaption></figure>")
                items.append(("media", None, ref, word))
        joined: list = []
        for x in items:  # texts without a medium between them are one
            if joined and x[0] == joined[-1][0] == "text":
                joined[-1] = ("text", f"{joined[-1][1]} {x[1]}", None, None)
            else:
                joined.append(x)
        rows.append((k, "".join(parts), 1, "z"))
        want[k] = [(i, *x) for i, x in enumerate(joined)]
    rows += [rows[0], (None, None, 1, "z"), (99, "<p>long</p>" * 30_000, 1, "z")]
    pages = spark.createDataFrame(rows, "page_id long, html string, pos int, caption string")
    seqs = media.sequences(pages)
    got = {}
    for r in seqs.collect():
        got.setdefault(r.page_id, []).append([tuple(x) for x in r["items"]])
    assert all(got[k] == [v] * (2 if k == 0 else 1) for k, v in want.items()) and got[None] == [[]] and got[99][0][0][2] == " ".join(["long"] * 30_000)
    known = spark.createDataFrame([(str(i), i) for i in range(8)], "digest string, n int")
    found = sorted((r.page_id, r.pos, r.caption, r.n) for r in media.resolve(seqs, known).filter("page_id > 0").collect() if r.n is not None)
    assert found == sorted((k, x[0], x[4], int(x[3][7:])) for k, v in want.items() for x in v if k and x[1] == "media" and x[3] != "sha256:8")
    assert media.sequences(pages.limit(0)).count() == 0


def test_page_query(spark, tmp_path) -> None:
    frame(spark, ["abc", None, "q"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "u", "<p>hi<br>ho</p>"), (1, "u", None), (7, "u", "<![foo[bar]]>t")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.pos): r for r in op2.page_media_sequences(spark, str(tmp_path)).collect()}
    assert (got[(0, 0)].text, got[(0, 1)].caption) == ("hi ho", "text of 0")
    assert got[(0, 1)].payload_sha256 == hashlib.sha256(media.padded(b"abc")).hexdigest() and got[(1, 0)].payload_sha256 == hashlib.sha256(media.padded(b"")).hexdigest()
    assert {k[0] for k in got} == {0, 1, 7}


# -- 4 ----------------------------------------------------------------------------------------------------------------

LOG = "conv long, seq long, message long, kind string, role string, payload string"


def test_fold_edits_and_regenerations(spark) -> None:
    events = [(1, 2, 0, "delta", "user", "b"), (1, 1, 0, "delta", "user", "a"), (1, 3, 1, "delta", "assistant", "x"), (1, 4, 1, "regenerate", "assistant", None), (1, 5, 1, "delta", "assistant", "y"),
              (1, 6, 0, "edit", "user", "c"), (1, 7, 0, "delta", "user", "d"), (1, 8, 0, "seen", "user", "zz"), (2, 1, 0, "regenerate", None, None), (None, 1, 0, "delta", "user", "n")]
    got = {(r.conv, r.message): r.text for r in chat.fold(spark.createDataFrame(events, LOG)).collect()}
    assert got == {(1, 0): "cd", (1, 1): "y", (2, 0): "", (None, 0): "n"}
    assert chat.fold(spark.createDataFrame([], LOG)).count() == 0


def test_template_is_reversible(spark) -> None:
    rng = random.Random(2)
    rows = [(c, m, rng.choice(["user", "assistant", "a\n:b#<", None]), "".join(rng.choice(["\\", "<", "#", "</turn>\n", "\\l", "n", "é", "\n", "### Assistant:"]) for _ in range(rng.randint(0, 9)))) for c in range(40) for m in range(rng.randint(1, 5))]
    back = chat.parse(chat.render(spark.createDataFrame(rows, "conv long, message long, role string, text string")))
    got = {r.conv: [(t.role, t.text, t.learn) for t in r.turns] for r in back.collect()}
    assert got == {c: [(r or "", t, r == "assistant") for k, _, r, t in rows if k == c] for c in range(40)}


def test_chat_query(spark, tmp_path) -> None:
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "hi <b>")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op4.op4_chat_formatting(spark, str(tmp_path)).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(b"hi <b>").hexdigest() and got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nhi <b>\n").hexdigest()
    assert got[-7].loss_chars == len(op4.CONTROL)


def test_chat_keeps_repeated_and_tied_rows(spark, tmp_path) -> None:
    import duckdb

    rng = random.Random(12)
    rows = [(1, 0, "assistant", "answer one"), (1, 0, "assistant", "answer one"), (2, 3, "user", "x"), (2, 3, "user", "y"), (3, None, "assistant", "no turn"), (3, None, "user", None), (3, 1, None, "z"), (None, None, None, None)]
    rows += [(rng.randint(10, 30), rng.choice([None, 0, 1, 2]), rng.choice(["user", "assistant", "system"]), rng.choice([None, "", "a", "b</turn>\n#", "é" * 3000])) for _ in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, message string")
    df.repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(op4.op4_chat_formatting(spark, str(tmp_path)).collect(), key=lambda r: str(r.conv_id))
    told: dict = {}
    for c, t, role, text in [*rows, (-7, 0, "user", op4.CONTROL), (-7, 1, "assistant", op4.CONTROL)]:
        told.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        own = [x[2:] for x in sorted(told[r.conv_id])]
        loss = "".join(x for role, x in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))
    assert len(got) == len(told)
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(op4.ORACLE_SQL["op4_chat_formatting"])
    assert sorted(tuple(r[c] for c in want.columns) for r in got if r.conv_id is not None) == sorted(r for r in want.fetchall() if r[0] is not None)


# -- 10 ---------------------------------------------------------------------------------------------------------------

def luhn(s: str) -> bool:
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(k * 2 - 9 * (k > 4) for k in d[1::2])) % 10 == 0


def test_pseudonyms(spark) -> None:
    card, other = "4539578763621486", "4539 5787 6362 1486"
    texts = [f"pay {card}, then {other}.", f"again {card}", "4539578763621487 stays", "mail Ab.c9@x.example.com!", "ssn 123-45-6789 not 000-45-6789", "call +1 (017) 555-7713 at 10.1.2.3 not 300.1.2.3",
             "born 2024-02-29 not 2023-02-29, 31/12/1999", None, "", "v1.2.3", "card 4539578763621486 4539578763621486"]
    out = [r.text for r in pii.pseudonymised(frame(spark, texts, True)).orderBy("doc_id").collect()]
    new = out[1].split()[1]
    assert new != card and luhn(new) and len(new) == 16
    assert out[0] == f"pay {new}, then {new[:4]} {new[4:8]} {new[8:12]} {new[12:]}."  # linked across formats and documents
    assert out[2] == texts[2] and out[7:10] == [None, "", "v1.2.3"]
    assert re.fullmatch(r"mail [A-Z][a-z]\.[a-z]\d@x\.example\.com!", out[3]) and out[3] != texts[3]
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} not 000-45-6789", out[4]) and out[4] != texts[4]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} at \d+\.\d+\.\d+\.\d+ not 300\.1\.2\.3", out[5])
    assert "not 2023-02-29" in out[6] and "2024-02-29" not in out[6] and re.search(r", \d\d/\d\d/\d{4}$", out[6])
    assert out[10] == f"card {new} {new}"
    assert pii.pseudonymised(frame(spark, []), count_col="n").count() == 0


def test_pseudonyms_against_an_independent_feistel(spark) -> None:
    """Every kind computed by plain loops over integers and letters, forwards and back."""
    import datetime

    key = "k1"

    def rounds(kind: str, x: int, y: int, a: int, b: int, back: bool = False) -> tuple[int, int]:
        for r in (range(7, -1, -1) if back else range(8)):
            m = a if r % 2 == 0 else b
            f = lambda half: int(hashlib.sha256(f"{key}|{kind}|{r}|{half}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
            x, y = ((y - f(x)) % m, x) if back else (y, (x + f(y)) % m)
        return x, y

    def digits(kind: str, d: str, back: bool = False) -> str:
        n, u = len(d), len(d) // 2
        x, y = rounds(kind + str(n), int(d[:u]), int(d[u:]), 10**u, 10 ** (n - u), back)
        return f"{x:0{u}}{y:0{n - u}}"

    def check(body: str) -> str:
        return next(c for c in "0123456789" if luhn(body + c))

    rng = random.Random(4)
    values, want = [], []
    for _ in range(25):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        values.append(body + check(body))
        new = digits("card", body)
        want.append(new + check(new))
        assert digits("card", new, True) == body
        phone = "".join(rng.choice("0123456789") for _ in range(10))
        values.append(f"{phone[:3]}-{phone[3:6]}-{phone[6:]}")
        new = digits("phone", phone)
        want.append(f"{new[:3]}-{new[3:6]}-{new[6:]}")
        four = [rng.randrange(256) for _ in range(4)]
        values.append(".".join(map(str, four)))
        x, y = rounds("ip", four[0] * 256 + four[1], four[2] * 256 + four[3], 65536, 65536)
        want.append(f"{x // 256}.{x % 256}.{y // 256}.{y % 256}")
        area, group, serial = rng.choice([k for k in range(1, 900) if k != 666]), rng.randint(1, 99), rng.randint(1, 9999)
        values.append(f"{area:03}-{group:02}-{serial:04}")
        x, y = rounds("ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        want.append(f"{x + 1 + (x >= 665):03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}")
        day = datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(146_097))
        values.append(day.isoformat())
        n = (day - datetime.date(1800, 1, 1)).days
        x, y = rounds("date", n // 773, n % 773, 189, 773)
        want.append((datetime.date(1800, 1, 1) + datetime.timedelta(x * 773 + y)).isoformat())
        local = "".join(rng.choice("abzAZ09._") for _ in range(rng.randint(1, 9)))
        values.append(local + "@x.org")
        x, y = local[: len(local) // 2], local[len(local) // 2 :]
        for r in range(8):
            said = hashlib.sha256(f"{key}|email|{r}|{y}".encode()).hexdigest()
            move = lambda c, by: next((s[(s.index(c) + by) % len(s)] for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") if c in s), c)
            x, y = y, "".join(move(c, int(said[i % 16 * 4 : i % 16 * 4 + 4], 16)) for i, c in enumerate(x))
        want.append(x + y + "@x.org")
    got = [r.text for r in pii.pseudonymised(frame(spark, [f"is {v} so" for v in values]), key=key).orderBy("doc_id").collect()]
    assert got == [f"is {v} so" for v in want]


def test_pseudonyms_of_long_and_repeated_rows(spark) -> None:
    long = "filler words " * 30_000 + "mail ann@x.org " + "9" * 40 + " card 3782-822463-10005"
    rows = spark.createDataFrame([(1, long, "a", "b"), (1, long, "a", "b"), (None, "ann@x.org", "", "")], "doc_id long, text string, old string, _new0 string")
    got = pii.pseudonymised(rows, count_col="n").collect()
    name = got[2].text
    assert got[0] == got[1] and got[0].n == 2 and f"mail {name} " in got[0].text and "9" * 40 in got[0].text and len(got[0].text) == len(long)
    assert pii.session_key(spark) == pii.session_key(spark)
    try:
        spark.conf.set(pii.CONF, "other")
        assert pii.pseudonymised(rows, count_col="n").collect()[2].text != name
    finally:
        spark.conf.unset(pii.CONF)


def test_feistel_permutes_whole_domains(spark) -> None:
    days = spark.range(7 * 11).select(pii.feistel("k", F.lit("t"), F.floor(F.col("id") / 11), F.col("id") % 11, F.lit(7), F.lit(11)).alias("z"))
    assert len({(r.z.x, r.z.y) for r in days.collect()}) == 77
    four = spark.range(10_000).select(pii.permuted_digits("k", F.lit("t"), F.lpad(F.col("id").cast("string"), 4, F.lit("0"))).alias("d"))
    assert four.distinct().count() == 10_000


# -- 5 ----------------------------------------------------------------------------------------------------------------

def test_hamming_blocks_find_all_within_radius() -> None:
    rng = np.random.default_rng(1)
    masks = set(decontaminate.near_values(8, decontaminate.RADIUS // decontaminate.BLOCKS).tolist())
    for _ in range(300):
        flips = rng.choice(64, rng.integers(0, decontaminate.RADIUS + 1), replace=False)
        blocks = [sum(1 << (b % 8) for b in flips.tolist() if b // 8 == k) for k in range(8)]
        assert any(b in masks for b in blocks)


def test_decontamination_against_brute_force(spark) -> None:
    rng = random.Random(5)
    items = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (15, 20, 33, 50)] + ["", None, "just three words"]
    changed = items[3].split()
    changed[25] = "other"
    texts = some_texts(40, 8, (20, 90))
    texts[3] += " " + items[0] + " tail"
    texts[7] = items[1].upper() + "! " + texts[7]
    texts[9] += " " + " ".join(changed) + " x"
    texts[11] += " " + " ".join(items[2].split()[:15])  # half an item is no match
    texts += [None, "", items[2], "Just, three words."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.contaminated(frame(spark, texts, True), bench).collect()}

    def words(t: str | None) -> list[str]:
        return re.findall(r"[0-9a-z\u0080-￿]+", (t or "").lower())

    def bag(w: list[str]) -> Counter:
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    want = {}
    for d, t in enumerate(texts):
        w = words(t)
        for i, item in enumerate(items):
            n = len(words(item))
            if not n or len(w) < n or n < 5 and len(w) != n:
                continue
            b = bag(words(item))
            best = max(sum((bag(w[k : k + n]) & b).values()) / sum((bag(w[k : k + n]) | b).values()) for k in range(len(w) - n + 1))
            if best >= 0.8:
                want[(d, i)] = round(best, 6)
    assert got == want and len(want) >= 5
    assert decontaminate.clean(frame(spark, texts, True), bench).count() == len(texts) - len({d for d, _ in want})
    assert decontaminate.contaminated(frame(spark, texts), bench.limit(0)).count() == 0


def test_documents_shorter_than_an_item_and_short_items(spark) -> None:
    rng = random.Random(15)
    shared = [f"s{i}" for i in range(60)]  # a template of many items weighs little
    items = [[f"t{rng.randrange(10**6)}" for _ in range(n)] for n in (59, 40, 12)] + [[*(f"u{k}x{i}" for i in range(30)), *shared] for k in range(40)] + ["just three words".split(), ["lone"], "a b a b".split()]
    texts = [items[0][:58], items[0][3:], items[0][:40], items[1][:37] + ["x"], items[2][:5], items[5][:30], items[5][:27], items[0][:4], shared, []]
    texts += [["so", *items[-3], "it", "is", *items[-3]], items[-3][:2], ["Lone"], ["x"] * 9 + ["lone"], ["a"] + items[-1] + items[-1], items[2] + items[0][:50] + ["lone"]]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = frame(spark, [" ".join(x) for x in texts])
    got = {(r.doc_id, r.item_id): (round(r.similarity, 6), r.start_word, r.n_words) for r in decontaminate.contaminated(rows, bench).collect()}

    def bag(w: list[str], n: int) -> Counter:
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    held = Counter(x for w in items for x in bag(w, min(5, len(w))))
    want = {}
    for d, w in enumerate([x.lower() for x in t] for t in texts):
        for i, item in enumerate(items):
            n, best = min(len(item), len(w)), (0.0, 0, 0)
            for k in range(len(w) - n + 1 if n else 0):
                a, b = bag(w[k : k + n], min(5, n)), bag(item, min(5, len(item)))
                low, high = (sum(v / held.get(x, 1) for x, v in c.items()) for c in (a & b, a | b))
                best = max(best, (round(low / high, 6), -k, n))
            if best[0] >= 0.8:
                want[(d, i)] = (best[0], -best[1], n)
    assert got == want
    assert {(0, 0), (1, 0), (3, 1), (5, 5), (10, len(items) - 3), (13, len(items) - 2), (14, len(items) - 1)} <= set(want) and not {2, 4, 6, 7, 8, 9, 11} & {d for d, _ in want}
    assert decontaminate.clean(rows, bench).count() == len(texts) - len({d for d, _ in want})


def test_page_that_lists_a_whole_benchmark_in_bounded_memory(spark) -> None:
    import resource
    import tracemalloc

    rng = random.Random(31)
    items = [[f"q{rng.randrange(10**7)}" for _ in range(rng.randint(30, 60))] for _ in range(2000)]
    index = next(decontaminate.indexes(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")))
    page = pa.array([" ".join(" ".join(x) for x in items)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    tracemalloc.start()
    got = list(decontaminate.matches(index, page))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(x[1] for x in got) == list(range(2000)) and all(x[4] == 1 for x in got)
    assert peak < 300 << 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


def test_recall_of_the_radius(spark, monkeypatch) -> None:
    """Copies at similarities from 0.8 to 0.9, by changed words at random places, against all windows compared exactly."""
    rng = random.Random(41)
    items = [[f"r{rng.randrange(10**7)}" for _ in range(60)] for _ in range(70)]
    texts = []
    for x in items:
        own = list(x)
        own[rng.choice([0, 59])] = "c0"
        at = rng.randrange(5, 55)
        own[at] = "c1"
        texts.append(" ".join(["lead"] * 9 + own + ["tail"] * 9))
    index = next(decontaminate.indexes(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")))
    found = {(x[0], x[1]) for x in decontaminate.matches(index, pa.array(texts))}
    monkeypatch.setattr(decontaminate, "RADIUS", 64)
    every = next(decontaminate.indexes(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")))
    exact = {(x[0], x[1]) for x in decontaminate.matches(every, pa.array(texts))}
    assert len(exact) > 60 and found <= exact and len(found) >= 0.99 * len(exact)


def test_decontamination_of_repeated_rows_and_ties(spark) -> None:
    item = " ".join(WORDS[:20])
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item)], "item_id long, text string")
    rows = spark.createDataFrame([(7, f"{item} so {item}"), (7, f"{item} so {item}"), (None, item)], DOC)
    got = sorted(((r.doc_id, r.item_id, r.start_word) for r in decontaminate.contaminated(rows, bench).collect()), key=str)
    assert got == sorted([(7, 1, 0), (7, 1, 0), (7, 2, 0)] * 2 + [(None, 1, 0)] * 2 + [(None, 2, 0)], key=str)
    assert decontaminate.clean(rows, bench).count() == 0


def test_split_benchmark_has_the_weights_of_the_whole(spark, monkeypatch) -> None:
    shared = [f"s{i}" for i in range(40)]
    items = [[*(f"u{k}x{i}" for i in range(30)), *shared] for k in range(12)] + [[f"v{i}" for i in range(20)]]
    texts = [items[3][:30] + ["y"] * 40, ["z"] + items[5][:30] + shared[:20] + ["q"] * 20, items[7][:33], shared + ["p"] * 30, items[2][:60] + ["r"] * 10, [*items[-1], *shared]]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = frame(spark, [" ".join(x) for x in texts])

    def found() -> tuple[list, int, int]:
        got = sorted((r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in decontaminate.contaminated(rows, bench).collect())
        return got, decontaminate.clean(rows, bench).count(), len(list(decontaminate.indexes(bench)))

    whole = found()
    monkeypatch.setattr(decontaminate, "LARGEST", 1)
    parts = found()
    assert whole[2] == 1 and parts[2] == len(items)
    assert parts[:2] == whole[:2] and len(whole[0]) >= 2


# -- 3 ----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_against_brute_force(spark, order: int) -> None:
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS[:12]) for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, "", "A a\ta", "once only"]
    docs = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    c = Counter(tuple(w[i : i + k]) for w in docs for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(len(w) for w in docs)

    def s(h: tuple, w: str) -> float:
        if not h:
            return c[(w,)] / total
        return c[(*h, w)] / c[h] if c[(*h, w)] >= 2 else 0.4 * s(h[1:], w)

    got = {r.doc_id: (r.n_words, r.log_score) for r in lm_scoring.scored(frame(spark, texts, True), order).collect()}
    for i, w in enumerate(docs):
        assert got[i] == (len(w), pytest.approx(sum(np.log(s(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(len(w)))))
    assert lm_scoring.scored(frame(spark, [])).count() == 0


def test_trigram_query(spark, tmp_path) -> None:
    from moderix.llm import registry

    # "c" is seen twice behind "a b" and once behind "x b"; bigrams cannot tell the two
    frame(spark, ["a b c", "a b c", "x b c", "x b d"]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.log_score for r in registry.QUERIES["op3_lm_scoring"](spark, str(tmp_path)).collect()}
    ab, xb, b_c = np.log(2 / 12) + np.log(2 / 2), np.log(2 / 12) + np.log(2 / 2), np.log(3 / 4)
    assert got[0] == pytest.approx(ab + np.log(2 / 2), abs=1e-4)
    assert got[2] == pytest.approx(xb + np.log(0.4) + b_c, abs=1e-4)


def test_backoff_sql_on_repeated_and_long_rows(spark, tmp_path) -> None:
    import duckdb

    from moderix.llm import op3

    rng = random.Random(17)
    texts = [" ".join(rng.choice(WORDS[:9]) for _ in range(rng.choice([0, 1, 2, 3, 30]))) for _ in range(80)] + [None, "", " \t", " ".join(WORDS) * 200, "é É\nX x"]
    frame(spark, texts + texts[:20]).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duck.sql(op3.ORACLE_SQL["op3_lm_scoring"]).fetchall()}
    got = {r.doc_id: (r.n_words, r.log_score, r.mean_log_score) for r in op3.op3_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(got) == 105 and all(got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:], abs=1e-3) if want[k][0] else got[k] == (0, 0.0, None) for k in want)


def test_backoff_of_repeated_ids(spark) -> None:
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b"), (1, "d")], DOC).withColumn("chunk", F.lit(3)).withColumn("blob", F.lit("x"))
    got = sorted((str(r.doc_id), r.n_words) for r in lm_scoring.scored(rows).collect())
    assert got == [("1", 1), ("1", 3), ("1", 3), ("None", 2)]


def test_packed_keys() -> None:
    for n in (1, 2, 500):
        k = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        assert (lm_scoring.unpack(lm_scoring.pack(k)) == k).all()
        x = np.random.default_rng(1).choice(k, 3 * n)
        assert (lm_scoring.Places(k)(x) == np.searchsorted(k, x)).all()
        c = np.arange(n) * 10**k.size.bit_length() % 2**40
        assert (lm_scoring.unpack_counts(lm_scoring.pack_counts(c)) == c).all()


# -- 7 ----------------------------------------------------------------------------------------------------------------

def test_attribution(spark) -> None:
    from moderix.llm.op7 import vocabulary

    texts = ["one two\n\nthree\nfour", None, "", "\n\n", "é😀\nx" * 50]
    for rule in token_counts.RULES:
        for r in token_counts.counted(frame(spark, texts, True), *vocabulary(), rule=rule).collect():
            assert sum(r.sections) == pytest.approx(r.n_tokens if r.sections else 0)
    ends, bounds = np.array([4, 10]), np.array([0, 6, 9, 10])
    assert token_counts.allocated(ends, bounds, "first").tolist() == [2, 0, 0]
    assert token_counts.allocated(ends, bounds, "most").tolist() == [1, 1, 0]
    assert token_counts.allocated(ends, bounds, "share").tolist() == pytest.approx([1 + 2 / 6, 3 / 6, 1 / 6])
    two = spark.createDataFrame([(1, "ab", None), (2, "hello wor", "ld")], "doc_id long, a string, b string")
    assert [len(r.sections) for r in token_counts.counted(two, *vocabulary(), fields=("a", "b")).collect()] == [2, 2]


def test_attribution_against_brute_force(spark) -> None:
    """Every byte of every token looked up in its section, one by one."""
    from moderix.llm.op7 import vocabulary

    ranks, pattern = vocabulary()
    with open(ranks, "rb") as f:
        encoder, _ = token_counts.loaded(f.read(), pattern)
    rng = random.Random(19)
    texts = ["".join(rng.choice(["word", " ", "\n", "\n\n", "é", "😀", "12", "\r\n", "x" * 30]) for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "\n", "long line " * 20_000 + "\nz"]
    rows = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1.0, "x"), (None, "a\nb", 1.0, "x")], "doc_id long, text string, sections double, n_tokens string")
    for rule in token_counts.RULES:
        got = token_counts.counted(rows, *vocabulary(), rule=rule).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            text = (texts[r.doc_id] if r.doc_id is not None else "a\nb") or ""
            parts = re.findall(r"(?s)[^\n]*\n+|[^\n]+$", text)
            section = [i for i, x in enumerate(parts) for _ in x.encode()]
            out, at, crossing = [0.0] * len(parts), 0, set()
            tokens = encoder.encode_ordinary(text)
            for token in tokens:
                own = section[at : at + len(encoder.decode_single_token_bytes(token))]
                at += len(own)
                crossing |= {k for k in own if k != own[0]}
                if rule == "first":
                    out[own[0]] += 1
                elif rule == "most":
                    out[max(sorted(set(own)), key=own.count)] += 1
                else:
                    for k in own:
                        out[k] += 1 / len(own)
            assert (r.n_tokens, r.n_crossing) == (len(tokens), len(crossing)) and list(r.sections) == pytest.approx(out)
    assert token_counts.counted(rows.limit(0), *vocabulary()).count() == 0


# -- 6 ----------------------------------------------------------------------------------------------------------------

def test_language_fusion(spark) -> None:
    docs = spark.createDataFrame([(i, "the and of with house", "en") for i in range(20)] + [(100 + i, "der und von mit haus", "de") for i in range(20)], "doc_id long, text string, lang string")
    model = language_id.trained(docs)
    page = lambda lang, text: f'<html lang="{lang}"><body>{text}</body></html>'
    pages = spark.createDataFrame(
        [(1, "http://a.example.com/x", page("de", "the house and the house with the house of the")), (2, None, None), (3, "http://b.example.de/en/1", page("en", "")), (4, "https://de.w.org/", page("de", "der und haus"))]
        + [(10 + i, "http://h.org/", page("de", "der und von mit")) for i in range(20)] + [(50, "http://h.org/q", "<p>zzz</p>")], "page_id long, url string, html string")
    got = {r.page_id: (r.lang, r.p) for r in language_id.identified(pages, model).collect()}
    assert got[1][0] == "en" and got[4][0] == "de" and got[50][0] == "de" and got[3][0] == "en" and 0.4 < got[2][1] <= 1
    assert language_id.identified(pages, language_id.trained(docs.limit(0))).filter("lang is null").count() == pages.count()


def test_language_posterior_against_brute_force(spark) -> None:
    docs = spark.createDataFrame([(i, "the and of with house", "en") for i in range(20)] + [(100 + i, "der und von mit haus", "de") for i in range(20)] + [(200 + i, "le et de la maison", "fr") for i in range(5)], "doc_id long, text string, lang string")
    model = language_id.trained(docs)
    assert model.languages == ["de", "en", "fr"]
    rng = random.Random(6)
    words = "the and of house der und von haus le et maison x".split()
    rows = []
    for i in range(60):
        lang = rng.choice([None, "de", "EN", "fr", "xx"])
        url = rng.choice([None, "", "http://a.x.de/1", "http://b.x.de/en/2", "https://u@fr.y.org:8/fr", "http://A.x.DE/?q", "http://y.org/"])
        body = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 300])))
        rows.append((i, url, rng.choice([None, "", f"<html{f' lang={lang}' if lang else ''}><script>the the</script><p>{body}"]), 0))
    rows += [rows[3], rows[3], (None, *rows[5][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    text = model.scores(pa.array([re.sub(r"<script>.*?</script>|<[^>]*>", " ", r[2] or "") for r in rows]))
    local, hosts = [], []
    for r, t in zip(rows, text, strict=True):
        s = t.copy()
        m = re.search(r"<html lang=([A-Za-z]+)", r[2] or "")
        h = re.match(r"[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)", r[1] or "")
        h = h[1].lower() if h else ""
        path = re.match(r"[^?#]*?://[^/?#]*/([A-Za-z]{2})(?:[/?#-]|$)", r[1] or "")
        code = next((c for c in (path[1].lower() if path else "", h.split(".")[0], h.split(".")[-1]) if c in model.languages), None)
        for said, trust in ((m[1].lower() if m else None, language_id.DECLARED), (code, language_id.ADDRESS)):
            if said in model.languages:
                s += np.log([(trust + (1 - trust) / 3) if x == said else (1 - trust) / 3 for x in model.languages])
        s = np.exp(s - s.max())
        local.append(s / s.sum())
        hosts.append(h)
    name = lambda h: ".".join(h.split(".")[-2:]) if "." in h else ""
    mass = lambda key, of: sum((x for x, h in zip(local, hosts, strict=True) if key(h) == of), np.zeros(3))
    k = language_id.STRENGTH
    top = sum(local)
    top = (top + 1) / (top.sum() + 3)
    got = {}
    for r in language_id.identified(pages, model).collect():
        got.setdefault(r.page_id, []).append((r.lang, round(r.p, 9)))
    want = {}
    for r, x, h in zip(rows, local, hosts, strict=True):
        s = mass(lambda y: y.split(".")[-1], h.split(".")[-1])
        s = (s + k * top) / (s.sum() + k)
        m = mass(lambda y: (name(y), y.split(".")[-1]), (name(h), h.split(".")[-1]))
        m = (m + k * s) / (m.sum() + k)
        own = np.maximum(mass(lambda y: y, h) - x, 0)
        post = x * (own + k * m) / (own.sum() + k)
        want.setdefault(r[0], []).append((model.languages[int(post.argmax())], round(post.max() / post.sum(), 9)))
    assert {i: [x[0] for x in v] for i, v in got.items()} == {i: [x[0] for x in v] for i, v in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-6) for i in want for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True))
    assert language_id.identified(pages.limit(0), model).count() == 0


def test_many_languages_and_bounded_sample(spark) -> None:
    docs = spark.createDataFrame([(i, f"word{i % 300}", f"l{i % 300:03}") for i in range(1200)] + [(0, "word0", "l000"), (None, "x", "zz"), (5, "x", None)], "doc_id long, text string, lang string")
    assert len(language_id.trained(docs, 2).languages) == 300
    one = docs.filter("lang = 'l007'")
    ids = sorted(r[0] for r in one.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2).collect())
    counts = language_id.trained(docs.filter("lang = 'l007'").withColumn("text", F.col("doc_id").cast("string")), 2)
    assert counts.log_p.shape[0] == 1 and len(ids) == 2


def test_visible_text_in_linear_time() -> None:
    import time

    old = re.compile(r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(2)
    parts = ["<script", "</script >", "<!--", "-->", "<", ">", "a", " b ", "<STYLE>", "</style>", "</scripts>", "&amp;", "<p>"]
    import html as entities

    for _ in range(4000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert language_id.visible(page) == entities.unescape(old.sub(" ", page)), page
    for page in ("<script" * 200_000, "<!--" * 200_000, "<" * 400_000, "<style>x" * 100_000):
        start = time.time()
        language_id.visible(page)
        assert time.time() - start < 3


def test_language_held_out(spark) -> None:
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.trained(docs.filter("doc_id % 2 = 0"))
    rows = docs.filter("doc_id % 2 = 1 and length(text) > 200").select("text", "lang").toArrow()
    best = model.scores(rows.column("text").combine_chunks()).argmax(axis=1)
    right = np.mean([model.languages[b] == lang for b, lang in zip(best, rows.column("lang").to_pylist(), strict=True)])
    assert right > 0.95


# -- 1 ----------------------------------------------------------------------------------------------------------------

def test_ordinal_model_orders_grades(spark) -> None:
    rng = random.Random(3)
    texts, grade = [], []
    for _ in range(600):
        k = rng.choice([0, 0, 0, 2, 4, 8])
        w = [rng.choice(WORDS) for _ in range(60)] + ["scum"] * k
        rng.shuffle(w)
        texts.append(" ".join(w))
        grade.append([0, 2, 4, 8].index(k))
    rows = spark.createDataFrame([(i, t, g, 1) for i, (t, g) in enumerate(zip(texts[:400], grade[:400], strict=True))], "id long, text string, grade int, said int")
    m = toxicity.fitted(rows)
    assert (np.diff(m.thresholds) > 0).all()
    severity, p = m.severity(pa.array(texts[400:]))
    g = np.array(grade[400:])
    means = [severity[g == k].mean() for k in range(4)]
    assert means == sorted(means) and ((p >= 0.5) == (g > 0)).mean() > 0.97
    assert m.severity(pa.array([None, ""], pa.string()))[1].max() < 0.5
    assert toxicity.fitted(rows.limit(0)).severity(pa.array(["x"]))[0].tolist() == [0.0]


def test_chosen_features_and_severity_against_brute_force(spark) -> None:
    """Shares of documents counted word by word, and the cumulative-link formula written out, on nulls, long and repeated texts."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS[:50]) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    texts = [t + (" scum vile" if i % 2 else "") for i, t in enumerate(texts)] + [None, "", "scum " * 40_000, "SCUM Vile", "scum vile"]
    grade = [i % 2 for i in range(80)] + [0, 0, 1, 1, 1]
    rows = spark.createDataFrame(list(zip(range(85), texts, grade, strict=True)), "id long, text string, grade int")

    def features(t: str | None) -> Counter:
        words = re.findall(r"[0-9a-z]+", (t or "").lower())
        return Counter(x for w in words for x in (("", w), (4, w[:4]), (6, w[:6])))

    held = [features(t) for t in texts]
    n1, n0 = sum(grade), len(grade) - sum(grade)
    want = set()
    for f in {x for h in held for x in h}:
        a, b = (sum(f in h for h, g in zip(held, grade, strict=True) if g == k) for k in (1, 0))
        pooled = (a + b + 1) / (n1 + n0 + 2)
        z = (a / n1 - b / n0) / (pooled * (1 - pooled) * (1 / n1 + 1 / n0)) ** 0.5
        if z >= toxicity.LEAST_Z and a / n1 >= toxicity.LEAST_LIFT * (b + 0.5) / n0:
            want.add(f)
    names = toxicity.chosen(rows.select("text", F.col("grade").alias("toxic")), n1, n0)
    known = {f: next(h for _, _, hs in toxicity.feature_hashes(pa.array([f[1]])) for h in [hs[{"": 0, 4: 1, 6: 2}[f[0]]]]) for f in want}
    assert set(names.tolist()) == {int(h) for h in known.values()} and len(names) == len(want) > 3
    m = toxicity.fitted(rows)
    severity, p = m.severity(pa.array(texts))
    weight = dict(zip(m.features.tolist(), m.weights.tolist(), strict=True))
    for i, h in enumerate(held):
        raw = sum(weight[int(known[f])] * np.log2(1 + c) for f, c in h.items() if f in known)
        above = [1 / (1 + np.exp(t - raw)) for t in m.thresholds]
        assert severity[i] == pytest.approx(sum(above)) and p[i] == pytest.approx(above[0])


def test_toxicity_rows(spark) -> None:
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, None, 6), (2, "", 7)], "doc_id long, text string, severity int")
    none = toxicity.trained(rows, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert sorted(str(r.doc_id) for r in toxicity.scored(rows, none).collect()) == ["1", "1", "2", "None"]
    assert toxicity.screened(rows, none).columns == rows.columns and toxicity.screened(rows, none).count() == 4
    assert toxicity.scored(rows.limit(0), none).count() == 0


def test_toxicity_held_out(spark) -> None:
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.trained(docs, labels.filter("doc_id % 3 <> 0"))
    rows = docs.join(labels.filter("doc_id % 3 = 0"), "doc_id").select("text", "toxic").toArrow()
    said = model.severity(rows.column("text").combine_chunks())[1] >= 0.5
    toxic = rows.column("toxic").to_numpy() == 1
    assert said[toxic].mean() > 0.85 and said[~toxic].mean() < 0.02


# -- pipeline -----------------------------------------------------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark, tmp_path) -> None:
    pipeline = pytest.importorskip("corpus_pipeline")
    clean = some_texts(30, 21, (40, 80))
    toxic = [t + " scum scum moron scum moron" for t in some_texts(40, 22, (40, 80))]
    copies = near_copies(12, 23, 100, 2)
    item = " ".join(WORDS[100:130])
    texts = clean + toxic + copies + [clean[0] + " " + item + " " + clean[1][:40]] + ["card 4539578763621486 " + clean[2][::-1], None, ""]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(30 <= i < 70)) for i in range(0, 70)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in pipeline.STAGES:
        before = {r[0] for r in docs.select("doc_id").collect()}
        docs = stages.written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = before - {r[0] for r in docs.select("doc_id").collect()}
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "pii":
            assert "4539578763621486" not in docs.filter("doc_id = 83").first().text
    assert kept["toxicity"] == set(range(30, 70))
    left = [t if i not in kept["toxicity"] else None for i, t in enumerate(texts)]
    assert kept["near_duplicates"] == {i for i, (n, c) in brute(left, 5, 80, 100).items() if c != i}
    assert kept["decontamination"] == {82} and not kept["pii"] and not kept["sentencepiece"]
    assert pipeline.run(spark, str(tmp_path)).count() == docs.count()
