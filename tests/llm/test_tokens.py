import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilgrid.llm import bpe_tree, packing, token_files
from veilgrid.llm.chunks import PieceEncoder
from veilgrid.llm.common import scratch
from veilgrid.llm.queries import op4_bpe_tree, op6_token_files, op8_packing

ALPHABET = list(" \n'sretdmÀÉéßäñabcXYZ0129.,!*|-“”́ħ中😀\t")


def some_texts(n, longest, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_whole(name):
    e = PieceEncoder(P.path(name), limit=200)
    t = Tokenizer.from_file(P.path(name))
    for x in [*some_texts(1500, 40), "<|endoftext|> a", "hello <|endoftext|> world", "a\n<|startoftext|>b <|endoftext", "x \0 \1", "  two  spaces ", "don't we'll"]:
        assert e.encode([x])[0] == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)
    assert e.encode([None, ""]) == [b"", b""]


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_tree_gives_the_ids_of_the_library(library):
    c = bpe_tree.TreeCodec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, leaf=5, window=2, bytes_=3)
    for x in [*some_texts(1500, 90, 4), "a" * 500, "", "x" + " " * 50 + "y", "\n" * 40, "a\x1cb \x1f \x85c\u2028 d\u00a0e"]:
        ids = c.encode(x)
        assert ids.tolist() == library(x) and c.decode(ids) == x.encode()


def test_pieces_break_where_the_library_breaks_them(library):
    """Every character of the basic plane, between a letter and a digit."""
    c = bpe_tree.TreeCodec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for k in range(0, 0x10000, 16):
        x = "".join(f"b{chr(i)}{chr(i)}7 {chr(i)}" for i in range(k, k + 16) if not 0xD800 <= i < 0xE000)
        assert c.encode(x).tolist() == library(x), hex(k)


def test_joined_halves_are_what_merging_the_whole_gives():
    c, r = bpe_tree.TreeCodec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(6)
    tokens = list(c.ranks)
    for n in range(6000):
        made = [bytes(r.choice(b"abcdeinrst") for _ in range(r.randrange(60))), bytes(r.choice(b"aab") for _ in range(r.randrange(80))), b"".join(r.choices(tokens, k=r.randrange(8))), r.randbytes(r.randrange(40))]
        data, c.bytes = made[n % 4], r.choice([1, 2, 4, 8])
        assert c.tokens(data) == c.merged(data)


def test_op4(spark, data, texts, odd, library):
    want = {r.doc_id: r.text or "" for r in texts.collect()}
    rows = op4_bpe_tree(spark, data).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = np.array(library(want[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(want[r.doc_id].encode()).hexdigest())
    got = bpe_tree.round_trip(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep_ids=True).collect()
    assert Counter(r.n_tokens for r in got)[0] == 2 and len(got) == 10
    assert {r.doc_id: r.ids for r in got}[4] == library(next(r.text for r in odd.collect() if r.doc_id == 4))
    assert bpe_tree.round_trip(odd.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_op6(spark, data, texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start = 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op6_token_files(spark, data).collect()}
    for r in sorted(texts.collect(), key=lambda r: r.doc_id):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got.pop(r.doc_id) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_token_files_are_written_as_asked(spark, texts, odd):
    import pyarrow.parquet as q

    path = scratch(spark, "test")
    token_files.write_tokens(token_files.encode_documents(texts, P.path("word_bpe_49k.json"), 2), path)
    f = q.ParquetFile(next(__import__("pathlib").Path(path.removeprefix("file://")).glob("part-*.parquet")))
    columns = {f.metadata.row_group(0).column(i).path_in_schema: f.metadata.row_group(0).column(i) for i in range(f.metadata.num_columns)}
    ids = next(c for n, c in columns.items() if n.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    some = token_files.read_tokens(spark, path, ["doc_id", "n_tokens"]).where("doc_id < 5")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "LessThan(doc_id,5)" in plan
    path = scratch(spark, "odd")
    token_files.write_tokens(token_files.encode_documents(odd, P.path("word_bpe_49k.json"), 2), path)
    rows = sorted(token_files.positions(token_files.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert len(rows) == 10 and rows[0].doc_id is None
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:])) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    path = scratch(spark, "none")
    token_files.write_tokens(token_files.encode_documents(odd.limit(0), P.path("word_bpe_49k.json"), 2), path)
    assert token_files.positions(token_files.read_tokens(spark, path)).count() == 0


def packed_well(rows, docs):
    """Each document's ids lie once in its pieces, sequences have no gaps; gives the sequences' fills."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    for doc, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(pieces.pop(doc), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert not pieces
    out = []
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        out.append(at)
    assert max(out) <= 1024
    return out


def test_op8(spark, data, texts, odd):
    fills = packed_well(op8_packing(spark, data).collect(), [(r.doc_id, r.text) for r in texts.collect()])
    assert all(f & (f - 1) == 0 for f in fills)  # nothing is padded
    few = odd.where("doc_id not in (5) or doc_id is null")
    packed_well(packing.pack(few, P.path("byte_bpe_50k.json"), held_bytes=5000).collect(), [(r.doc_id, r.text) for r in few.collect()])
    assert packing.pack(odd, P.path("byte_bpe_50k.json")).where("doc_id = 5").count() >= 2
    assert packing.pack(odd.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_the_chosen_level_is_the_best():
    r, p = random.Random(0), packing.SumOfSquares(0, capacity=20)
    for _ in range(400):
        size = r.randrange(1, 20)
        level = p.level[:20].copy()
        costs = {}
        for h in range(0, 20 - size + 1):
            if h == 0 or level[h]:
                after = level.copy()
                if h:
                    after[h] -= 1
                if h + size < 20:
                    after[h + size] += 1
                costs[h] = int((after[1:] ** 2).sum())
        assert costs[p.choose(size)] == min(costs.values())
        p.add_document(0, b"\0\0\0\0" * size)


@pytest.mark.parametrize("held,moves", [(64 << 20, False), (1 << 20, True)])
def test_windows_that_never_fill(held, moves):
    """9,000 open windows of one level: no two pieces of 600 tokens fit together."""
    left = []
    p = packing.SumOfSquares(0, held_bytes=held, moved=left.extend)
    for k in range(9000):
        p.add_document(k, k.to_bytes(4, "little") * 600)
        assert p.held <= held
    assert bool(left) == moves and len(left) + p.level[600] == 9000 and not p.rows
    p.close()
    q = packing.SumOfSquares(0)
    for piece in left:
        q.add(piece)
    q.close()
    tokens, fill = Counter(), Counter()
    for doc, start, n, _, total, sequence, offset in q.rows:
        assert total == 600 and offset == fill[sequence] and start == tokens[doc]
        tokens[doc] += n
        fill[sequence] += n
    assert tokens == dict.fromkeys(range(9000), 600) and all(f & (f - 1) == 0 for f in fill.values()) and sum(f < 1024 for f in fill.values()) <= 10


def test_the_second_round_goes_on_with_the_first(spark, texts):
    """However finely the table is cut, few sequences hold a piece that was cut to fill them."""
    rows = packing.pack(texts.repartition(16), P.path("byte_bpe_50k.json"))
    packed_well(rows.collect(), [(r.doc_id, r.text) for r in texts.collect()])
    assert rows.where(F.col("sequence_id") >= packing.SECOND).count() > 0
