"""Conversation repair, SentencePiece and fill-in-the-middle against brute force, the library and SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone.llm import infill, pieces, queries, repair

SF = "/root/testdata/sf0.001"


# -- op11 conversation repair


def brute_path(symbols, start=0, ends=repair.ENDS):
    """All states' least costs and audits, turn by turn."""
    now = {start: (0, "")}

    def insert(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                t = repair.NEXT[s][1]
                states[t] = min(states.get(t, (10**9, "")), (c + 3, a + "I"))
        return states

    now = insert(now)
    for x in symbols:
        then = {}
        for s, (c, a) in now.items():
            for t, more, letter in repair.EDGES[x][s]:
                then[t] = min(then.get(t, (10**9, "")), (c + more, a + letter))
        now = insert(then)
    return min((now[e] for e in ends if e in now), default=None)


@pytest.mark.parametrize("start", [0, 1, 2, 3])
def test_bidirectional_search_finds_the_least_audit(start):
    rng = random.Random(start)
    for n in [*range(9)] * 12 + [20, 40]:
        key = bytes(rng.choice([0, 1, 3, 3, 4, 6, 6, 7, 8, 9, 5]) for _ in range(n))
        assert repair.search(key, start, repair.ENDS) == brute_path(key, start)
        for end in range(4):
            assert repair.search(key, start, (end,)) == brute_path(key, start, (end,))


ROWS = [(1, 0, "system", "Be."), (1, 1, "user", "a."), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (1, 5, "user", " "), (2, None, None, None), (2, 3, "tool", "x!"), (2, None, "user", "x!"), (2, 3, "user", "y?"),
        (None, 1, "assistant", "q."), (None, 2, "", "q."), (3, 1, "user", "\t\n"), (4, 7, "system", "s."), (5, 1, "user", "é."), (5, 2, "assistant", "日本!"), (5, 3, "user", "é."), (5, 4, "system", "x.")]
COLUMNS = "conv_id long, turn long, role string, text string"


def odd(spark):
    rng = random.Random(9)
    more = [(rng.choice([10, 11, 12, 13]), rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "bot"]), rng.choice(["a.", "b", "c!", "d?", "e", None, ".", "f. "])) for _ in range(260)]
    return spark.createDataFrame([(*r, "x", 1, "k") for r in ROWS + more], COLUMNS + ", audit string, cost int, place string")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def by_sql(df):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(df.toPandas()).astype({"conv_id": "Int64", "turn": "Int64"}))
    rel = con.sql(repair.oracle_sql())
    return plain(tuple(None if v is None or v is pd.NA else v for v in r) for r in rel.fetchall())


def test_repair_matches_sql_on_odd_rows(spark):
    df = odd(spark)
    got = repair.repair_damaged(df)
    assert plain(got.select("conv_id", *repair.HEAD, "repaired_sha256").collect()) == by_sql(df)


def test_long_conversations_give_the_same(spark, monkeypatch):
    df, one = odd(spark), None
    for long, block in ((1000, 256), (2, 3), (20, 1), (20, 64)):
        monkeypatch.setattr(repair, "LONG", long)
        monkeypatch.setattr(repair, "BLOCK", block)
        got = plain(repair.repair_damaged(df).collect())
        one = one or got
        assert got == one
        turns = repair.repaired_turns(repair.damage(df)).collect()
        lines = {}
        for r in sorted(turns, key=lambda r: r.place):
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
            assert r.place == len(lines[r.conv_id])
        want = {i: hashlib.sha256("\n".join(lines.get(i, [])).encode()).hexdigest() for i, *_ in got}
        assert {r[0]: r[-1] for r in got} == want


def test_repaired_turns_are_in_the_pattern(spark):
    turns = repair.repaired_turns(spark.read.parquet(f"{SF}/conversations.parquet")).collect()
    roles = {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.place)):
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[0]
    assert roles and all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def test_repair_of_empty_tables_and_dropped_conversations(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert repair.repair_damaged(none).count() == 0 and repair.repaired_turns(none).count() == 0
    given = odd(spark).select("conv_id").distinct()
    got = repair.summaries(none, given).collect()
    assert len(got) == given.count() and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)


def test_repair_matches_sql(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert plain(queries.QUERIES["op11_repair"](spark, SF).collect()) == by_sql(df)


# -- op12 SentencePiece


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


LETTERS = ["a", "b", "the", "The", " ", "  ", "\n", "é", "日本", "▁", "▁▁", "\x00", "\t", "🙂", "x", "1", "22", "<s>", "</s>", "<0x41>", "​", "ﬁ", "Å", "①", "ｶﾞ", "　", "á", "\x01", "\x85"]


def mixed(rng, most):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randrange(most)))


@pytest.mark.parametrize("window", [1, 7, 1 << 16])
def test_pieces_match_the_library(spark, model, monkeypatch, window):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.load(model)
    monkeypatch.setattr(pieces, "WINDOW", window)
    rng = random.Random(window)
    texts = ["", " ", "▁", "x" * 5000, " " * 300, "日" * 700] + [mixed(rng, 40) for _ in range(300)] + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for text in texts:
        want = library.encode(text, return_type="proto").pieces
        ids, begins, ends = own.encode(text)
        assert ids.tolist() == library.encode(text) == [p.id for p in want]
        assert (begins.tolist(), ends.tolist()) == ([p.begin for p in want], [p.end for p in want])
        assert own.decode(ids) == library.decode(ids.tolist())


@pytest.mark.parametrize("settings", range(16))
def test_pieces_with_a_compiled_map(model, monkeypatch, settings):
    """Maps with case folding, all settings of the normaliser, and symbols that are given whole."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    monkeypatch.setattr(pieces, "WINDOW", 5)
    with open(model, "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    maps = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()
    rules, bit = spec.normalizer_spec, [bool(settings >> i & 1) for i in range(4)]
    rules.precompiled_charsmap = sentencepiece_model_pb2.ModelProto.FromString(maps).normalizer_spec.precompiled_charsmap
    rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces, spec.trainer_spec.treat_whitespace_as_suffix = bit
    if settings % 3:
        for at, piece in ((31000, "the b"), (31001, "éThe")):
            spec.pieces[at].type, spec.pieces[at].piece = pieces.DEFINED, piece
    raw = spec.SerializeToString()
    library, own, rng = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Pieces(raw), random.Random(settings)
    for _ in range(200):
        text = mixed(rng, 25)
        want = library.encode(text, return_type="proto").pieces
        ids, begins, ends = own.encode(text)
        assert (ids.tolist(), begins.tolist(), ends.tolist()) == tuple([getattr(p, k) for p in want] for k in ("id", "begin", "end"))
        assert own.decode(ids) == library.decode(ids.tolist())


def test_piece_digests_of_odd_rows(spark, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [None, "", " ", "a b", "a b", "é ñ 日本語 \x1c end", "word " * 30_000, "x" * 20_000]
    rows = spark.createDataFrame([(i % 7, t, "ids", 1, "d") for i, t in enumerate(texts)], "doc_id int, text string, ids string, begins int, decoded string")
    got = plain(pieces.token_digests(rows, model).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i % 7, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert got == plain(want)
    assert pieces.token_digests(rows.limit(0), model).count() == 0


# -- op13 fill-in-the-middle


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def infill_rows(spark):
    rng = random.Random(6)
    texts = [None, "", "a", "é", "abc", "<P>x", "a<S", ">b<", "<", "日本 text 🙂🙂", "word " * 4000, "é" * 5000, "x" * 9000] + ["".join(rng.choice(["a", "Bc", " ", "é", "日", "🙂", "<", "P", ">", "S", "M", "\n", "1"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [(i if i != 40 else None, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again")]


@pytest.mark.parametrize("chunk", [3, 64, 1 << 20])
def test_infill_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(infill, "CHUNK", chunk)
    rows = infill_rows(spark)
    df = spark.createDataFrame([(*r, "f", 1, "o") for r in rows], "doc_id long, text string, form string, n int, output string")
    out = infill.transform(df)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(out.form, out.output)).collect()
    want = [brute_infill(*r) for r in rows]
    assert plain(got) == plain(want) and {w[2] for w in want} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert plain(infill.digests(df).collect()) == plain((*w[:5], sha(w[5]), sha(w[6])) for w in want)
    assert infill.digests(df.limit(0)).count() == 0


def test_infill_places_of_many_texts():
    rng = random.Random(7)
    texts = ["".join(rng.choice(["ab", " ", "é", "日", "🙂"]) for _ in range(rng.randrange(30))) for _ in range(50)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    for chunk in (1, 5, 1000):
        places = infill.Places(data, offsets, chunk)
        assert (places.points_before(offsets) == np.cumsum([0] + [len(t) for t in texts])).all()
        units = [len(re.findall("[A-Za-z]+|[^A-Za-z]", t)) for t in texts]
        assert (places.units_before(offsets) == np.cumsum([0] + units)).all()


def test_infill_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert plain(queries.QUERIES["op13_infill"](spark, SF).collect()) == plain(con.sql(infill.oracle_sql()).fetchall())
