"""Byte-level BPE: encoding and decoding with DuckDB recursive queries inside each partition.

Each task keeps a DuckDB connection with tables made from the tokenizer's rank file: the
vocabulary, the merge table (left id, right id, merged id), and for neighbouring tokens
the ranks of the merges that could reach over them. A batch of distinct pieces becomes
token-position rows; a recursive query joins neighbouring tokens to the merge table and
contracts each piece's leftmost pair of minimum rank until no pair is left. Pieces of
``LONG_PIECE`` bytes and more contract, in each round, every pair that no merge of lower
rank can reach first; the ids are the same and the rounds few, so that a run of letters of
any length takes time in proportion to it. Decoding joins the ids of each text to the
vocabulary and aggregates their bytes in order of position.

Only pieces that the task does not hold are sent to DuckDB; what it holds is bounded by
``CACHE_BYTES`` of its true size, and a text's ids are the concatenation of its words' ids.
The rank file is read on the driver and broadcast (a tokenizer's vocabulary, some 50,000
entries).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words and ids that a Python worker holds, with what each costs beside its characters.
CACHE_BYTES, ENTRY_BYTES = 48_000_000, 190
#: Pieces sent to DuckDB at once, and the bytes from which a piece is contracted in many places at once.
PIECES_AT_ONCE, LONG_PIECE = 20_000, 96
#: Rounds of one recursive query over long pieces, which goes on from its result.
ROUNDS = 16
#: Bytes of text handled at once, whole texts at least; of ids decoded at once.
CHUNK_BYTES = 2_000_000
#: No merge.
NONE = 2**31 - 1

#: White space of any script followed by a space: there, cutting at spaces would not keep to the pattern.
_SPACES = re.compile(
    rb"(?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)\x20"
)

_CONTRACT = """
    WITH RECURSIVE t(w, toks, step) AS (
      SELECT w, toks, 0 FROM start
      UNION ALL
      SELECT t.w, toks[:i - 1] || [m] || toks[i + 2:], step + 1
      FROM t JOIN (
        SELECT p.w, min((g.m::BIGINT << 32) + p.i) AS best
        FROM (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[2:], 1) AS i FROM t) p
        JOIN merges g ON g.l = p.l AND g.r = p.r
        GROUP BY p.w) b ON b.w = t.w, LATERAL (SELECT (best & 4294967295)::INT AS i, (best >> 32)::INT AS m))
    SELECT t.w, t.toks FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) e ON e.w = t.w AND e.step = t.step
"""

#: Neighbouring tokens (l, r): the rank of their merge; the least rank of a merge of r with something that ends
#: with l and the longest of these; the same for l and what begins with r; whether no merge of the result ranks lower.
_PAIRS = f"""
    WITH a AS (SELECT e.part AS l, g.r, min(g.m) AS low_l, max(n.n)::INT AS far_l
               FROM merges g JOIN parts e ON e.tok = g.l AND e.last = 1 JOIN lens n ON n.tok = g.l GROUP BY ALL),
    b AS (SELECT g.l, e.part AS r, min(g.m) AS low_r, max(n.n)::INT AS far_r
          FROM merges g JOIN parts e ON e.tok = g.r AND e.first = 1 JOIN lens n ON n.tok = g.r GROUP BY ALL),
    low AS (SELECT m, min(x) AS x FROM (SELECT l AS m, m AS x FROM merges UNION ALL SELECT r, m FROM merges) GROUP BY m)
    SELECT l, r, coalesce(g.m, {NONE}) AS m, coalesce(low_l, {NONE}) AS low_l, coalesce(low_r, {NONE}) AS low_r,
           coalesce(far_l, 0)::INT AS far_l, coalesce(far_r, 0)::INT AS far_r, coalesce(low.x > g.m, true) AS safe
    FROM a FULL JOIN b USING (l, r) LEFT JOIN merges g USING (l, r) LEFT JOIN low ON low.m = g.m
"""

_PAIR_COLUMNS = ["l", "r", "m", "low_l", "low_r", "far_l", "far_r", "safe"]

#: Long pieces. A pair may be contracted before its turn if no merge of lower rank can touch it first (``clear``: none
#: exists whose other part ends, or begins, as the text does, or no pair of lower rank is within that part's length)
#: and no merge of its result ranks lower here (``calm``). Overlapping pairs of one rank go from the left, every other
#: one. What is not calm waits until it is the leftmost least pair as far as any chain of merges can reach. Pieces
#: stand further apart than that.
_CONTRACT_LONG = """
    WITH RECURSIVE t(w, pos, tok, step) AS (
      SELECT w, pos, tok, 0 FROM start
      UNION ALL
      (WITH p AS (
        SELECT *, lead(w) OVER o AS next_w, lead(tok) OVER o AS next_tok FROM t WINDOW o AS (ORDER BY pos)),
      q AS (
        SELECT p.w, pos, tok, step, coalesce(g.m, {none}) AS m, coalesce(low_l, {none}) AS low_l,
               coalesce(low_r, {none}) AS low_r, coalesce(far_l, 0) AS far_l, coalesce(far_r, 0) AS far_r,
               coalesce(safe, true) AS safe
        FROM p LEFT JOIN pairs g ON g.l = p.tok AND g.r = CASE WHEN next_w = w THEN next_tok END),
      r AS (
        SELECT *, lag(w) OVER o IS NOT DISTINCT FROM w AS has_l, lead(w) OVER o IS NOT DISTINCT FROM w AS has_r,
               lead(w, 2) OVER o IS NOT DISTINCT FROM w AS has_rr, lag(m) OVER o AS m_l, lag(low_l) OVER o AS reach_l,
               lead(low_r) OVER o AS reach_r, lag(tok) OVER o AS tok_l, lead(tok, 2) OVER o AS tok_rr,
               coalesce(lag(far_l) OVER o, 0) AS span_l,
               greatest(1, coalesce(lead(far_r) OVER o + lead(pos, 2) OVER o - pos - 2, 0)) AS span_r
        FROM q WINDOW o AS (ORDER BY pos)),
      s AS (
        SELECT *, min(m) OVER (ORDER BY pos RANGE BETWEEN span_l PRECEDING AND 1 PRECEDING) AS near_l,
               min(m) OVER (ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND span_r FOLLOWING) AS near_r,
               min(m) OVER (ORDER BY pos RANGE BETWEEN {wide} PRECEDING AND 1 PRECEDING) AS wide_l,
               min(m) OVER (ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND {wide} FOLLOWING) AS wide_r
        FROM r),
      u AS (
        SELECT s.*, has_l AND m_l = s.m AS goes_on,
               s.m < {none} AND (NOT has_r OR reach_r >= s.m OR coalesce(near_r >= s.m, true)) AND
               (NOT has_l OR CASE WHEN m_l = s.m THEN reach_l >= s.m ELSE reach_l > s.m OR coalesce(near_l > s.m, true) END) AS clear,
               s.safe OR (coalesce(x.low_l > s.m, true) AND coalesce(y.low_r > s.m, true)) AS calm,
               s.m < {none} AND coalesce(wide_l > s.m, true) AND coalesce(wide_r >= s.m, true) AS least
        FROM s LEFT JOIN pairs x ON NOT s.safe AND has_l AND x.l = tok_l AND x.r = s.m
               LEFT JOIN pairs y ON NOT s.safe AND has_rr AND y.l = s.m AND y.r = tok_rr),
      runs AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS run FROM u),
      v AS (
        SELECT w, pos, tok, step, m, least OR (bool_and(clear AND calm) OVER (PARTITION BY run) AND
               row_number() OVER (PARTITION BY run ORDER BY pos) % 2 = 1) AS hit
        FROM runs),
      z AS (SELECT *, coalesce(lag(hit) OVER (ORDER BY pos), false) AS eaten, bool_or(hit) OVER (PARTITION BY w) AS more FROM v)
      SELECT w, pos, CASE WHEN hit THEN m ELSE tok END, step + 1 FROM z WHERE more AND NOT eaten AND step < {rounds}))
    SELECT w, pos, tok, step FROM t QUALIFY step = max(step) OVER (PARTITION BY w)
"""

_DECODE = """
    SELECT d.w, string_agg(v.bytes, '' ORDER BY d.pos) AS bytes
    FROM ids d JOIN vocab v ON v.id = d.id GROUP BY d.w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 bytes and a rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Tables:
    """A vocabulary as a few arrays, made once on the driver: its size is that of the tokenizer."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.tokens = b"".join(ranks)
        self.sizes = np.array([len(t) for t in ranks], np.int32)
        self.ids = np.array(list(ranks.values()), np.int32)
        db = duckdb.connect(config={"threads": 1, "temp_directory": ""})

        def parts() -> Iterator[tuple[int, int, int, int]]:
            for token, rank in ranks.items():
                for cut in range(len(token)):
                    if (part := ranks.get(token[cut:])) is not None:
                        yield rank, part, 0, 1
                    if (part := ranks.get(token[: cut + 1])) is not None:
                        yield rank, part, 1, 0

        merges = (
            (left, right, merged)
            for token, merged in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        )
        _load(db, "merges", _table(["l", "r", "m"], merges))
        _load(db, "parts", _table(["tok", "part", "first", "last"], parts()))
        _load(db, "lens", pa.table({"tok": self.ids, "n": self.sizes}))
        self.pairs = {k: v.to_numpy() for k, v in zip(_PAIR_COLUMNS, db.sql(_PAIRS).to_arrow_table().columns, strict=True)}
        db.close()


def _load(db, name: str, table: pa.Table) -> None:
    db.register("incoming", table)
    db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
    db.unregister("incoming")


class Codec:
    """Vocabulary and merge table in DuckDB, and the words met so far."""

    def __init__(self, tables: Tables, pattern: str):
        import duckdb
        import regex

        self.pieces = regex.compile(pattern)
        ends = np.cumsum(tables.sizes).tolist()
        tokens = [tables.tokens[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.single = {token: rank.to_bytes(4, "little") for token, rank in zip(tokens, tables.ids.tolist(), strict=True)}
        self.byte = np.array([int.from_bytes(self.single[bytes([i])], "little") for i in range(256)], np.int32)
        self.longest = int(tables.sizes.max())
        # nothing is spilled to a folder of the machine: a batch fits or fails
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        _load(self.db, "pairs", pa.table(tables.pairs))
        self.db.execute(f"CREATE TEMP TABLE merges AS SELECT l, r, m FROM pairs WHERE m < {NONE}")
        _load(self.db, "vocab", pa.table({"id": tables.ids, "bytes": pa.array([b.hex() for b in tokens])}))
        self.spaced: dict[bytes, bytes] = {}
        self.plain: dict[bytes, bytes] = {}
        self.held = 0  # bytes of words and ids

    def _rows(self, query: str) -> pa.Table:
        return self.db.sql(query).to_arrow_table()

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each distinct, non-empty piece that is not itself a token."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.packed_pieces(pieces)]

    def packed_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The same as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        small = [i for i, p in enumerate(pieces) if len(p) < LONG_PIECE]
        large = [i for i, p in enumerate(pieces) if len(p) >= LONG_PIECE]
        for at in range(0, len(small), PIECES_AT_ONCE):
            some = small[at : at + PIECES_AT_ONCE]
            toks, sizes = self._bytes([pieces[i] for i in some])
            lists = pa.ListArray.from_arrays(np.append(0, sizes.cumsum()).astype(np.int32), pa.array(toks))
            _load(self.db, "start", pa.table({"w": np.arange(len(some), dtype=np.int32), "toks": lists}))
            found = self._rows(_CONTRACT)
            toks = found.column(1).combine_chunks()
            self._put(out, [some[w] for w in found.column(0).to_pylist()], toks.flatten().to_numpy(), toks.value_lengths().to_numpy())
        while large:  # some CHUNK_BYTES at once, one piece at least
            ends = np.cumsum([len(pieces[i]) for i in large])
            some = large[: max(1, int(np.searchsorted(ends, CHUNK_BYTES // 4, side="right")))]
            large = large[len(some) :]
            self._contract_long(some, pieces, out)
        return out

    def _contract_long(self, some: list[int], pieces: list[bytes], out: list[bytes]) -> None:
        wide = 3 * self.longest
        query = _CONTRACT_LONG.format(none=NONE, wide=wide, rounds=ROUNDS)
        toks, sizes = self._bytes([pieces[i] for i in some])
        w = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
        _load(self.db, "start", pa.table({"w": w, "pos": np.arange(len(toks)) + (wide + 1) * w.astype(np.int64), "tok": toks}))
        while True:
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE settled AS {query}")
            if not self.db.sql(f"SELECT bool_or(step = {ROUNDS}) FROM settled").fetchall()[0][0]:
                break
            self.db.execute("CREATE OR REPLACE TEMP TABLE start AS SELECT w, pos, tok FROM settled")
        found = self._rows("SELECT w, tok FROM settled ORDER BY pos")
        self.db.execute("DROP TABLE settled")
        self._put(out, some, found.column(1).to_numpy(), np.bincount(found.column(0).to_numpy(), minlength=len(some)))

    def _bytes(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the bytes of all pieces, and each piece's number of them."""
        return self.byte[np.frombuffer(b"".join(pieces), np.uint8)], np.array([len(p) for p in pieces], np.int64)

    @staticmethod
    def _put(out: list[bytes], where: list[int], toks: np.ndarray, sizes: np.ndarray) -> None:
        packed, begin = toks.astype("<u4").tobytes(), 0
        for i, end in zip(where, (4 * np.cumsum(sizes)).tolist(), strict=True):
            out[i] = packed[begin:end]
            begin = end

    def decode_rows(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Bytes of consecutive groups of ids, by a join and an ordered aggregation."""
        ends = np.cumsum(sizes)
        pos = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)
        w = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        _load(self.db, "ids", pa.table({"w": w, "pos": pos.astype(np.int32), "id": ids.astype(np.int32)}))
        found, out = self._rows(_DECODE), [b""] * len(sizes)
        for k, text in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            out[k] = bytes.fromhex(text)
        return out

    def decode_packed(self, packed: list[bytes]) -> Iterator[bytes]:
        """Bytes of each binary of ids, some CHUNK_BYTES of ids at once, one binary at least."""
        sizes = np.array([len(x) // 4 for x in packed], np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(packed):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + CHUNK_BYTES // 4, side="right")))
            yield from self.decode_rows(np.frombuffer(b"".join(packed[at:stop]), "<u4"), sizes[at:stop])
            at = stop

    def learn(self, words: list[bytes], known: dict[bytes, bytes], lead: bytes) -> None:
        """Encode distinct words that begin with lead, as little-endian unsigned 32-bit ids."""
        findall, ids = self.pieces.findall, self.single
        pieces, ends = [], []  # flat: a list for each word would be work for the collector
        for w in words:
            pieces += findall((lead + w).decode("utf-8", "replace"))
            ends.append(len(pieces))
        pieces = [p.encode() for p in pieces]
        new = list({p for p in pieces if p not in ids})
        fresh = dict(zip(new, self.packed_pieces(new), strict=True))
        packed = [ids.get(p) or fresh[p] for p in pieces]
        begin = size = 0
        for w, end in zip(words, ends, strict=True):
            own = packed[begin] if end == begin + 1 else b"".join(packed[begin:end])
            known[w] = own
            size += len(w) + len(own)
            begin = end
        self.held += size + ENTRY_BYTES * len(words)

    def _forget(self, plain: set[bytes], spaced: set[bytes]) -> None:
        """Keep the words of the texts at hand only."""
        self.plain = {w: self.plain[w] for w in plain if w in self.plain}
        self.spaced = {w: self.spaced[w] for w in spaced if w in self.spaced}
        self.held = sum(ENTRY_BYTES + len(w) + len(x) for known in (self.plain, self.spaced) for w, x in known.items())

    def texts(self, batch: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text; ids are little-endian unsigned 32-bit integers."""
        rows, spaced, plain = [], set(), set()
        for text in batch:
            if _SPACES.search(text):
                own = [p.encode() for p in self.pieces.findall(text.decode("utf-8", "replace"))]
                rows.append((own, []))
                plain.update(own)
            else:
                own = text.split(b" ")
                rows.append((own[:1] if own[0] else [], own[1:]))
                plain.update(rows[-1][0])
                spaced.update(rows[-1][1])
        if self.held > CACHE_BYTES:
            self._forget(plain, spaced)
        for words, known, lead in ((plain, self.plain, b""), (spaced, self.spaced, b" ")):
            if new := [w for w in words if w not in known]:
                self.learn(new, known, lead)
        packed = [b"".join(map(self.plain.__getitem__, a)) + b"".join(map(self.spaced.__getitem__, b)) for a, b in rows]
        yield from zip(packed, self.decode_packed(packed), strict=True)


def _table(names: list[str] | str, rows: Iterator[tuple]) -> pa.Table:
    """Integer rows as columns, a bounded number of rows as Python objects at once."""
    from itertools import islice

    parts = []
    while part := list(islice(rows, 20_000)):
        parts.append(np.array(part, np.int32))
    found = np.concatenate(parts) if parts else np.zeros((0, len(names)), np.int32)
    return pa.table({name: np.ascontiguousarray(found[:, i]) for i, name in enumerate(names)})


_WORKER: dict[str, Codec] = {}


def _codec(token: str, sent, pattern: str) -> Codec:
    if token not in _WORKER:
        _WORKER.clear()
        _WORKER[token] = Codec(sent.value, pattern)
    return _WORKER[token]


def _sent(df: DataFrame, ranks_path: str):
    return df.sparkSession.sparkContext.broadcast(Tables(read_ranks(ranks_path)))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(row to start at, texts) of some CHUNK_BYTES each; null is empty."""
    raw, part, size, at = texts.cast(pa.binary()), [], 0, 0
    for i, text in enumerate(raw):
        part.append(text.as_py() or b"")
        size += len(part[-1])
        if size >= CHUNK_BYTES or i == len(raw) - 1:
            yield at, part
            part, size, at = [], 0, i + 1


def encode(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids; one row per input row, no shuffle.

    Whole texts, each match of pattern on its own, no special tokens; ids is a binary
    of little-endian unsigned 32-bit integers, decoded_sha256 the digest of what the
    ids decode to. A null text is the empty text and has no token. An empty input
    gives no rows; only the id and the text are read; repeated rows encode alike.
    """
    thin = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()
    sent, token = _sent(df, ranks_path), hashlib.sha256(repr((ranks_path, pattern)).encode()).hexdigest()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(token, sent, pattern)
        for batch in batches:
            for at, texts in _chunks(batch.column(1)):
                n, a, b, ids = [], [], [], []
                for packed, back in codec.texts(texts):
                    n.append(len(packed) // 4)
                    a.append(hashlib.sha256(packed).hexdigest())
                    b.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        ids.append(packed)
                out = [batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names)

    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return thin.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded (binary) of binaries of little-endian unsigned 32-bit ids; null ids decode to nothing."""
    thin = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    id_type = thin.schema["doc_id"].dataType.simpleString()
    sent, token = _sent(df, ranks_path), hashlib.sha256(repr((ranks_path, pattern)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(token, sent, pattern)
        for batch in batches:
            for at, packed in _chunks(batch.column(1)):
                back = list(codec.decode_packed(packed))
                out = [batch.column(0).slice(at, len(back)), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "decoded"])

    return thin.mapInArrow(run, f"doc_id {id_type}, decoded binary")
