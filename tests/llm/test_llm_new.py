"""SentencePiece pieces against the library, fill-in-the-middle against a plain cut, repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("residuum.llm")

from pyspark.sql import functions as F  # noqa: E402

from residuum.llm import infill, pieces, queries, repair  # noqa: E402

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def piece_file():
    return queries.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(piece_file):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_file)


def odd_texts():
    rng = random.Random(11)
    drawn = ["abcdefghijklmnopqrstuvwxyz", "aeht n", "▁ ab", "aàéüß 你好的是😀ﬁ", "\x00\t\n\r \x85 a", "0123456789abcdef", "in ther", "<s>/un k"]
    plain = ["", " ", "  ", None, "a", " a", "a  b ", "\n", "▁x", " ▁ x", "▁ ▁", "<s></s>", "<0x41>", "a" * 5000, "ab" * 3000, "the" * 2000, "   " * 333, "é" * 4097]
    return plain + ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in drawn for _ in range(300)]


def test_pieces_are_the_librarys(piece_file, library):
    texts = odd_texts() + ["".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=50_000))]
    made = pieces.model(piece_file)
    flat, offsets = made.encode(pa.array(texts), 2)
    want = [[*library.encode(t or ""), 2] for t in texts]
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert made.decode(flat, offsets) == [library.decode(w) for w in want]


def test_merges_of_any_vocabulary_are_those_of_one_at_a_time(piece_file):
    """Scores that contradict each other, as a learnt vocabulary seldom has them."""

    def one_by_one(word, made):
        while True:
            pairs = [(made.rank[p], k, p) for k in range(len(word) - 1) if (p := int(made.pairs.get(np.array(word[k : k + 1]), np.array(word[k + 1 : k + 2]))[0])) != pieces.NONE]
            if not pairs:
                return word
            _, k, p = min(pairs)
            word = [*word[:k], p, *word[k + 2 :]]

    rng = random.Random(3)
    for _ in range(30):
        made = object.__new__(pieces.PieceModel)
        names = list("ab") + sorted({"".join(rng.choices("ab", k=rng.randrange(2, 5))) for _ in range(12)})
        ids = {n: i for i, n in enumerate(names)}
        splits = [(ids[n[:k]], ids[n[k:]], ids[n]) for n in names for k in range(1, len(n)) if n[:k] in ids and n[k:] in ids]
        made.pairs = pieces.PairTable(*map(list, zip(*splits)))
        made.rank = np.array([rng.randrange(6) for _ in names] + [pieces.NONE], np.int32)
        words = [[rng.randrange(2) for _ in range(rng.randrange(1, 14))] for _ in range(40)]
        starts = np.cumsum([0] + [len(w) for w in words[:-1]])
        got, first = made.merge(np.array(sum(words, []), np.int32), starts)
        assert [got[a:b].tolist() for a, b in zip(first, first[1:])] == [one_by_one(w, made) for w in words]


def test_decoding_any_ids(piece_file, library):
    rng = random.Random(7)
    lists = [[rng.choice([rng.randrange(32_000), rng.randrange(259), 259]) for _ in range(rng.randrange(9))] for _ in range(2_000)]
    flat, offsets = np.array(sum(lists, []), np.int64), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    assert pieces.model(piece_file).decode(flat, offsets) == [library.decode(x) for x in lists]


def test_op11_contract(spark, library):
    told = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in told:
        ids = [*library.encode(r.text or ""), 2]
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_pieces(spark, SF).collect()} == want


def test_pieces_of_odd_tables(spark, piece_file, library):
    rows = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, "a b", None), (1, "a b", None)], "ids long, text string, decoded string")
    got = pieces.encode(rows, piece_file, out="tokens")
    assert got.columns == ["ids", "decoded", "tokens"]
    assert sorted(len(r.tokens) for r in got.collect()) == [1, 3, 3, 3]
    back = pieces.decode(pieces.encode(rows.drop("decoded"), piece_file), piece_file)
    assert sorted(r.decoded for r in back.collect()) == ["", "a b", "a b", "a b"]
    assert pieces.decode(pieces.encode(rows.limit(0), piece_file), piece_file).collect() == []


TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def test_events_count_and_place_tokens():
    rng = random.Random(2)
    for _ in range(2_000):
        text = "".join(rng.choice(rng.choice(["abZ", "a <P>SM", "é你\n. ", "0 x"])) for _ in range(rng.randrange(30)))
        tokens = TOKEN.findall(text)
        found = infill.Events(text, ("<P>", "<S>", "<M>"), rng.choice([1, 2, 3, 5, 1000]))
        assert found.n == len(tokens) and found.marked == any(s in text for s in ("<P>", "<S>", "<M>"))
        assert [found.place(r) for r in range(len(tokens) + 1)] == [len("".join(tokens[:r])) for r in range(len(tokens) + 1)]


def cut_plainly(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    form = "plain" if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if form == "plain":
        return len(tokens), form, None, None, text
    return len(tokens), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_infill_of_odd_tables(spark):
    texts = [None, "", "one two. drei", "über é\n\n", "a<P>b", "<S", "x" * 300_000, "1 " * 200_000, "<<S>>>", "tail <M"] + odd_texts()[:400]
    rows = [(k if k else None, t, "z") for k, t in enumerate(texts)] + [(2, "one two. drei", None)] * 2
    made = infill.transform(spark.createDataFrame(rows, "doc_id long, text string, output string"))
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.select("*", infill.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut_plainly(r.doc_id, r.text) and r.again == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def cheapest(rows):
    """(cost, audit, repaired) by a search over all edits of (role, text, fault)."""

    @cache
    def best(k, state, inserted):
        options = []
        if k == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if k < len(rows):
            role, text, fault = rows[k]
            more = 3 if fault == "truncated" else 0
            c, s, out = best(k + 1, state, 0)
            options.append((c + 4, "D" + s, out))
            if fault in (None, "truncated"):
                new = role[:1]
                if new == "s" and state == "" or new == "u" and state != "u" or new == "a" and state == "u":
                    c, s, out = best(k + 1, new, 0)
                    options.append((c + more, "K" + s, ((role, text), *out)))
                new = "a" if state == "u" else "u"
                c, s, out = best(k + 1, new, 0)
                options.append((c + more + 3, "R" + s, (({"u": "user", "a": "assistant"}[new], text), *out)))
        if inserted < 3:
            new = "a" if state == "u" else "u"
            c, s, out = best(k, new, inserted + 1)
            options.append((c + 3, "I" + s, (({"u": "user", "a": "assistant"}[new], ""), *out)))
        return min(options, default=(10**9, "~", ()))

    return best(0, "", 0)


def described(rows):
    """The contract's columns for one conversation's (turn, role, text) in order."""
    seen, told, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        stripped = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        told.append((role, text, fault))
        if fault:
            counts[fault] += 1
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    cost, audit, repaired = cheapest(tuple(told))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in repaired))


def wanted(rows):
    """op13's rows from (conv, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        kept += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    # no test has different rows of one turn, whose order would be by hash
    return {c: described(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0))) for c, r in out.items()}


def found(spark, rows, tmp_path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_repair(spark, str(tmp_path)).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_op13_contract(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, rows, tmp_path) == wanted(rows)


def odd_conversations(n, most, seed):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "ok?", "d.\n", " ", None, "e", "."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, most)):
            if rng.random() < 0.9:
                role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "use", None, ""])
                rows.append((conv or None, turn if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}."))
    once = list({(r[0], r[1]): r for r in rows}.values())
    return once + [r for r in once for _ in range(rng.choice([0, 0, 0, 0, 1, 4]))]


def test_repair_of_odd_conversations(spark, tmp_path):
    rows = odd_conversations(400, 14, 1)
    assert found(spark, rows, tmp_path) == wanted(rows)


def test_repair_of_conversations_over_many_ranges(spark, tmp_path):
    rows = odd_conversations(3, 300, 4) + [(9, t, "user" if t % 3 else "assistant", "same.") for t in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, tmp_path) == wanted(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_parts_of_a_conversation_join_to_the_whole():
    rng = random.Random(8)
    for _ in range(1_500):
        rows = [(k, rng.choice("suaut"), rng.choice([0, 0, 0, 1, 2, 4]), rng.choice([1, 1, 1, 3])) for k in range(rng.randrange(1, 14))]
        cuts = sorted({0, len(rows), *[rng.randrange(len(rows) + 1) for _ in range(3)]})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        ahead = repair.NOTHING
        for part in reversed(parts):
            ahead = repair._earlier(repair._matrix(part), ahead)
        whole = repair.sweep(rows, repair.NOTHING)[0]
        assert repair.choose(repair.START, *ahead) == repair.choose(repair.START, *whole)


def test_repair_gives_turns(spark):
    rows = [(1, 1, "user", "a."), (1, 2, "user", "b."), (1, 2, "user", "b."), (1, 3, "assistant", "c"), (2, 0, "assistant", "x."), (2, 1, "assistant", " ")]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))).orderBy("conv", "place").collect()
    assert [(r.conv, r.role, r.text) for r in got] == [(1, "user", "a."), (1, "assistant", ""), (1, "user", "b."), (1, "assistant", "c"), (2, "user", ""), (2, "assistant", "x.")]
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
