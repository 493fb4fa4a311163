"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant texts.

The given models are of the BPE kind. A row of pieces is the encoding of its text if and only if each two neighbours are the encoding of their own joint text. So encoding is a search for the best path through the lattice of pieces, where a step weighs 0 if the two pieces are such neighbours and minus infinity if not; exactly one path is not minus infinity. That is max-plus algebra, and it can be cut anywhere:

* A boundary state is the piece that covers the last character before a cut, with the number of characters by which it reaches over the cut.
* A chunk gives a matrix of weights from the states at its left cut to those at its right cut (`transfer`). Matrices are combined associatively (`combine`).
* Products go up a tree: neighbouring matrices are combined, then their products. From the top down, the state at the cut between two factors is the one that weighs most from the state before them to the state behind them (`inner_states`). FAN matrices meet in a task; of a text with more, the products of FAN neighbours go on as the matrices of a next level, so no task grows with a text.
* With the states at both cuts known, every chunk is traced back by itself (`trace`).

Inside a chunk the search needs to run only near the cuts: before a word's leading space mark every path has a piece boundary, as no piece holds the mark behind another character, and any two pieces may meet there. Text between two such places is encoded by the library. A text without spaces is searched from end to end.

Texts of at most `chunk_chars` characters are one chunk and need no matrix. Workers turn SLICE_BYTES of texts or chunks into Python objects at a time, and what they remember is bounded.

Defined results: null and empty texts have no pieces and decode to the empty text; rows that repeat an id are encoded one by one; a literal space mark (U+2581) decodes to a space, as in the library; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import arrow_rows, drop, save, slices, table, text_or_empty, workspace

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 1 << 15
MARK = "▁"
#: Pairs of pieces that a worker remembers (some 10 MB).
REMEMBERED = 50_000
#: Matrices that are multiplied in one task.
FAN = 256
NEVER = float("-inf")

State = tuple[str, int]
Matrix = dict[State, dict[State, float]]

_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model, loaded once a worker."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity" or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and no normalisation are supported")
        proto.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        normal = [(p.piece, k) for k, p in enumerate(proto.pieces) if p.type == 1]
        alone = self.bare.encode([p for p, _ in normal], num_threads=1)
        self.id_of = {p: k for (p, k), ids in zip(normal, alone, strict=True) if ids == [k]}
        self.longest = max(map(len, self.id_of))
        inner = [p for p in self.id_of if MARK in p[1:] and p.strip(MARK)]
        if inner:
            raise ValueError(f"pieces with a space mark inside: {inner[:3]}")
        self.byte_ids = {int(p.piece[1:-1], 16): k for k, p in enumerate(proto.pieces) if p.type == 6}
        self.bytes_of = [p.piece.replace(MARK, " ").encode() if p.type == 1 else bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b"" for p in proto.pieces]
        self.meet: dict[tuple[str, str], bool] = {}

    def ids(self, piece: str) -> list[int]:
        """A piece's id; the ids of its bytes if it is a character beyond the vocabulary."""
        known = self.id_of.get(piece)
        return [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]

    def neighbours(self, a: str, b: str) -> bool:
        """Whether a and b are the encoding of their joint text."""
        known = self.meet.get((a, b))
        if known is None:
            known = a not in self.id_of or b not in self.id_of or self.bare.encode(a + b) == [self.id_of[a], self.id_of[b]]
            if len(self.meet) >= REMEMBERED:
                self.meet.clear()
            self.meet[a, b] = known
        return known

    def encode_plain(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text that starts with a mark. The library is faster on whole texts than a memory of words: a tenth of a corpus's words are new."""
        return array("i", self.bare.encode(text)).tobytes()

    def decode(self, ids: np.ndarray, first: bool = True) -> bytes:
        """The text of some ids; the mark that encoding puts before a text is dropped if they are its first."""
        table_ = self.bytes_of
        raw = b"".join([table_[i] for i in ids.tolist()])
        return raw[1:] if first and raw[:1] == b" " else raw

    def ending(self, text: str, end: int, begin: int) -> Iterator[str]:
        """Pieces that end at `end` and start at `begin` or later; a character beyond the vocabulary is a piece of its own."""
        for size in range(1, min(self.longest, end - begin) + 1):
            piece = text[end - size : end]
            if size == 1 or piece in self.id_of:
                yield piece

    def search(self, text: str, at: int, last: str | None, ends: range, like: dict[int, str] | None = None) -> dict[int, str]:
        """From a piece that ends at `at`: position -> the last piece of the one path that gets there, for positions up to ends.

        Once it agrees with `like`, an earlier search of the same text, over a longest piece's length, it goes on in the same way.
        """
        reach: dict[int, str] = {}
        same = 0
        for end in range(at + 1, ends.stop):
            if like is not None:
                same = same + 1 if end - 1 > at and reach.get(end - 1) == like.get(end - 1) else 0
                if same > self.longest:
                    reach.update({e: x for e, x in like.items() if e >= end})
                    break
            for piece in self.ending(text, end, at):
                begin = end - len(piece)
                before = last if begin == at else reach.get(begin)
                if begin == at and last is None or before is not None and self.neighbours(before, piece):
                    reach[end] = piece
                    break
        return reach

    @staticmethod
    def walk(reach: dict[int, str], end: int, at: int) -> list[str] | None:
        """The path from at to end, None if there is none."""
        out = []
        while end > at:
            piece = reach.get(end)
            if piece is None:
                return None
            out.append(piece)
            end -= len(piece)
        return out[::-1] if end == at else None


def resets(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """First and last position from begin to before end where every path has a boundary: a mark behind another character."""
    first = begin
    while (first := text.find(MARK, first, end)) > 0 and text[first - 1] == MARK:
        first += 1
    if first <= 0:
        return None
    last = end
    while (last := text.rfind(MARK, begin, last)) > 0 and text[last - 1] == MARK:
        pass
    return first, last


class Chunk:
    """A stretch [left, right) of a text, seen with the characters around it that pieces over its cuts can cover."""

    def __init__(self, model: Pieces, seen: str, left: int, right: int):
        self.model, self.text, self.left, self.right = model, seen, left, right

    def states(self, cut: int) -> list[State]:
        """All states that the text allows at a cut."""
        if cut == 0:
            return [("", 0)]
        out = []
        for end in range(cut, min(len(self.text), cut + self.model.longest - 1) + 1):
            out += [(p, end - cut) for p in self.model.ending(self.text, end, 0) if end - len(p) < cut]
        return out

    def _entry(self, state: State) -> tuple[int, str | None]:
        return self.left + state[1], state[0] or None

    def _exits(self) -> list[State]:
        if self.right == len(self.text):
            return [s for s in self.states(self.right) if s[1] == 0]
        return self.states(self.right)

    def transfer(self) -> Matrix:
        """Weights from the states at the left cut to those at the right cut: 0 or, left out, minus infinity."""
        exits, out = self._exits(), {}
        longest = self.model.longest
        spot = resets(self.text, min(self.left + longest, self.right), self.right)
        if spot:
            late = self._search_to_exits(spot[1], None)
            good = {s: 0.0 for s in exits if self._leads(late, spot[1], s)}
        reach: dict[int, str] | None = None
        for state in self.states(self.left):
            at, last = self._entry(state)
            if spot:
                early = self.model.search(self.text, at, last, range(at, spot[0] + 1))
                row = good if self.model.walk(early, spot[0], at) is not None else {}
            else:
                reach = self._search_to_exits(at, last, reach)
                row = {s: 0.0 for s in exits if self._leads(reach, at, s) or s[0] == state[0] and self.right + s[1] == at}
            if row:
                out[state] = row
        return out

    def _search_to_exits(self, at: int, last: str | None, like: dict[int, str] | None = None) -> dict[int, str]:
        return self.model.search(self.text, at, last, range(at, min(len(self.text), self.right + self.model.longest - 1) + 1), like)

    def _leads(self, reach: dict[int, str], at: int, state: State) -> bool:
        end = self.right + state[1]
        return reach.get(end) == state[0] and self.model.walk(reach, end, at) is not None

    def trace(self, enter: State, leave: State) -> bytes:
        """Ids of the pieces behind `enter`, up to and with `leave`."""
        model, (at, last) = self.model, self._entry(enter)
        end = self.right + leave[1]
        flat = lambda path: np.array([i for p in path for i in model.ids(p)], "<i4").tobytes()
        spot = resets(self.text, min(self.left + model.longest, self.right), self.right)
        if not spot:
            return flat(model.walk(model.search(self.text, at, last, range(at, end + 1)), end, at) or [])
        head = model.walk(model.search(self.text, at, last, range(at, spot[0] + 1)), spot[0], at)
        tail = model.walk(model.search(self.text, spot[1], None, range(spot[1], end + 1)), end, spot[1])
        middle = model.encode_plain(self.text[spot[0] : spot[1]]) if spot[1] > spot[0] else b""
        return flat(head) + middle + flat(tail)


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product. It is associative."""
    out: Matrix = {}
    for enter, row in a.items():
        sums: dict[State, float] = {}
        for mid, x in row.items():
            for leave, y in b.get(mid, {}).items():
                sums[leave] = max(sums.get(leave, NEVER), x + y)
        if sums:
            out[enter] = sums
    return out


def products(matrices: list[Matrix]) -> list[list[Matrix]]:
    """The levels of a tree of products: neighbours are combined two by two, a last one without a neighbour goes up as it is."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([combine(*low[k : k + 2]) if k + 1 < len(low) else low[k] for k in range(0, len(low), 2)])
    return levels


def inner_states(matrices: list[Matrix], enter: State, leave: State) -> list[State]:
    """The states at all cuts, from `enter` before the first matrix to `leave` behind the last, of the one best path."""
    levels = products(matrices)
    states = [enter, leave]
    for low in levels[-2::-1]:
        cuts = [states[0]]
        for k in range(0, len(low), 2):
            before, behind = states[k // 2], states[k // 2 + 1]
            if k + 1 < len(low):
                row = low[k].get(before, {})
                cuts.append(max(row, key=lambda s, row=row, b=low[k + 1], to=behind: row[s] + b.get(s, {}).get(to, NEVER)))
            cuts.append(behind)
        states = cuts
    return states


def last_state(whole: Matrix) -> State:
    """The state behind a whole text, from the product of all its matrices."""
    row = whole[("", 0)]
    return max(row, key=row.get)


def states_at_cuts(matrices: list[Matrix]) -> list[State]:
    """The state at every cut of the one best path, from the first cut to the text's end."""
    return inner_states(matrices, ("", 0), last_state(products(matrices)[-1][0]))


def encode_giant(model: Pieces, text: str, chunk_chars: int) -> bytes:
    """The whole scheme in one process, as the brute-force tests call it."""
    whole = MARK + text.replace(" ", MARK)
    chunks = [Chunk(model, *seen) for seen in cut(whole, chunk_chars, model.longest)]
    states = states_at_cuts([c.transfer() for c in chunks])
    return b"".join(c.trace(a, b) for c, a, b in zip(chunks, states, states[1:], strict=False))


def cut(whole: str, chunk_chars: int, longest: int) -> Iterator[tuple[str, int, int]]:
    """(seen text, left, right) of each chunk: the chunk with the characters that pieces over its cuts can cover."""
    for begin in range(0, len(whole), chunk_chars):
        end = min(begin + chunk_chars, len(whole))
        low = max(0, begin - longest)
        yield whole[low : end + longest], begin - low, end - low


def _pack(matrix: Matrix) -> tuple[list[str], list[int], list[int], list[int]]:
    """States of both cuts in one list, and the index pairs of the weights that are 0."""
    states = list(dict.fromkeys([*matrix, *(s for row in matrix.values() for s in row)]))
    at = {s: k for k, s in enumerate(states)}
    pairs = [(at[a], at[b]) for a, row in matrix.items() for b in row]
    return [s[0] for s in states], [s[1] for s in states], [a for a, _ in pairs], [b for _, b in pairs]


def _unpack(names: list[str], over: list[int], enter: list[int], leave: list[int]) -> Matrix:
    out: Matrix = {}
    for a, b in zip(enter, leave, strict=True):
        out.setdefault((names[a], over[a]), {})[names[b], over[b]] = 0.0
    return out


CHUNK_ROWS = "key string, id {id}, chunk int, seen string, left int, right int"


def _chunks(giants: DataFrame, model: str, chunk_chars: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = pieces(model).longest
        for batch in slices(batches, 2):
            schema = pa.schema([("key", pa.string()), ("id", batch.schema.field(1).type), ("chunk", pa.int32()), ("seen", pa.string()), ("left", pa.int32()), ("right", pa.int32())])
            for key, id_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, (seen, left, right) in enumerate(cut(MARK + text.replace(" ", MARK), chunk_chars, longest)):
                    yield arrow_rows({"key": [key], "id": [id_], "chunk": [k], "seen": [seen], "left": [left], "right": [right]}, schema)

    return giants.mapInArrow(run, CHUNK_ROWS.format(id=kind))


MATRIX_ROWS = "key string, chunk int, names array<string>, over array<int>, enter array<int>, leave array<int>"
_INTS = pa.list_(pa.int32())
MATRIX_SCHEMA = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("names", pa.list_(pa.string())), ("over", _INTS), ("enter", _INTS), ("leave", _INTS)])
STATE_ROWS = "key string, chunk int, enter string, enter_over int, leave string, leave_over int"
STATE_SCHEMA = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("enter", pa.string()), ("enter_over", pa.int32()), ("leave", pa.string()), ("leave_over", pa.int32())])


def _matrix_rows(keys: list[str], chunks: list[int], matrices: list[Matrix]) -> pa.RecordBatch:
    packed = [_pack(m) for m in matrices]
    return arrow_rows({"key": keys, "chunk": chunks} | {n: [p[k] for p in packed] for k, n in enumerate(("names", "over", "enter", "leave"))}, MATRIX_SCHEMA)


def _transfers(chunks: DataFrame, model: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            cols = batch.to_pydict()
            yield _matrix_rows(cols["key"], cols["chunk"], [Chunk(pieces(model), s, a, b).transfer() for s, a, b in zip(cols["seen"], cols["left"], cols["right"], strict=True)])

    return chunks.select("key", "chunk", "seen", "left", "right").mapInArrow(run, MATRIX_ROWS)


def _matrices(t: pa.Table) -> tuple[list[int], list[Matrix]]:
    rows = sorted(t.to_pylist(), key=lambda r: r["chunk"])
    return [r["chunk"] for r in rows], [_unpack(r["names"], r["over"], r["enter"], r["leave"]) for r in rows]


def _combined(matrices: DataFrame, fan: int) -> DataFrame:
    """The next level: the product of each `fan` neighbours of a text."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, own = _matrices(t)
        return pa.Table.from_batches([_matrix_rows([key[0].as_py()], [key[1].as_py()], [products(own)[-1][0]])])

    grouped = matrices.withColumn("above", F.expr(f"chunk div {fan}").cast("int")).groupBy("key", "above")
    return grouped.applyInArrow(run, MATRIX_ROWS)


def _state_rows(key: str, chunks: list[int], states: list[State]) -> pa.Table:
    cols: dict = {"key": [key] * len(chunks), "chunk": chunks}
    for side, part in (("enter", states), ("leave", states[1:])):
        cols |= {side: [s[0] for s in part[: len(chunks)]], f"{side}_over": [s[1] for s in part[: len(chunks)]]}
    return pa.Table.from_batches([arrow_rows(cols, STATE_SCHEMA)])


def _scan(transfers: DataFrame, root: str, fan: int) -> DataFrame:
    """key, chunk and the states at the chunk's two cuts: up the levels of products, and down again."""
    levels = [transfers]
    while not levels[-1].where(F.col("chunk") >= fan).isEmpty():
        levels.append(save(_combined(levels[-1], fan), f"{root}/level{len(levels)}"))

    def top(t: pa.Table) -> pa.Table:
        chunks, own = _matrices(t)
        return _state_rows(t.column("key")[0].as_py(), chunks, states_at_cuts(own))

    def inner(t: pa.Table) -> pa.Table:
        chunks, own = _matrices(t.select(MATRIX_SCHEMA.names))
        first = {n: t.column(f"above_{n}")[0].as_py() for n in STATE_SCHEMA.names[2:]}
        return _state_rows(t.column("key")[0].as_py(), chunks, inner_states(own, (first["enter"], first["enter_over"]), (first["leave"], first["leave_over"])))

    states = levels[-1].groupBy("key").applyInArrow(top, STATE_ROWS)
    for low in levels[-2::-1]:
        above = states.select(F.col("key"), F.col("chunk").alias("above"), *[F.col(n).alias(f"above_{n}") for n in STATE_SCHEMA.names[2:]])
        known = low.withColumn("above", F.expr(f"chunk div {fan}").cast("int")).join(above, ["key", "above"])
        states = known.groupBy("key", "above").applyInArrow(inner, STATE_ROWS)
    return states


def _traced(chunks: DataFrame, states: DataFrame, model: str, kind: str) -> DataFrame:
    joined = chunks.join(states, ["key", "chunk"]).select("key", "id", "chunk", "seen", "left", "right", "enter", "enter_over", "leave", "leave_over")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            c = batch.to_pydict()
            ids = []
            for k in range(batch.num_rows):
                chunk = Chunk(pieces(model), c["seen"][k], c["left"][k], c["right"][k])
                ids.append(chunk.trace((c["enter"][k], c["enter_over"][k]), (c["leave"][k], c["leave_over"][k])))
            schema = pa.schema([("key", pa.string()), ("id", batch.schema.field(1).type), ("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))])
            yield arrow_rows({"key": c["key"], "id": batch.column(1), "chunk": c["chunk"], "ids": _lists(ids)}, schema)

    return joined.mapInArrow(run, f"key string, id {kind}, chunk int, ids array<int>")


def _lists(parts: list[bytes]) -> pa.Array:
    sizes = np.array([0] + [len(p) // 4 for p in parts])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))


def _text(model: Pieces, ids: np.ndarray) -> str:
    return model.decode(ids).decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk_chars: int = CHUNK_CHARS, fan: int = FAN, decoded: bool = False) -> DataFrame:
    """The id and token_ids of every row of docs, and the text that they decode to if that is wanted: a task then needs one worker, not one for each way."""
    root = workspace(docs.sparkSession, "pieces")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    small, giant = rows.where(F.length("text") <= chunk_chars), rows.where(F.length("text") > chunk_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in slices(batches, 1):
            ids = [p.encode_plain(MARK + t.replace(" ", MARK)) if t else b"" for t in batch.column(1).to_pylist()]
            back = {"text": pa.array([_text(p, np.frombuffer(i, "<i4")) for i in ids], pa.string())} if decoded else {}
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "token_ids": _lists(ids)} | back)

    direct = small.mapInArrow(run, f"{id_col} {kind}, token_ids array<int>" + ", text string" * decoded)
    # rows that repeat an id must not mix: a row's key also holds its text's digest and a number of its own
    keyed = giant.select(F.concat_ws("/", F.expr("uuid()"), F.xxhash64("id", "text").cast("string")).alias("key"), "id", "text")
    chunks = save(_chunks(keyed, model, chunk_chars, kind), f"{root}/chunks")
    states = _scan(save(_transfers(chunks, model), f"{root}/transfers"), root, fan)
    traced = save(_traced(chunks, states, model, kind), f"{root}/traced")
    drop(docs.sparkSession, f"{root}/chunks")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    whole = traced.groupBy("key").agg(F.first("id").alias(id_col), F.flatten(F.transform(parts, lambda x: x["ids"])).alias("token_ids")).select(id_col, "token_ids")
    return direct.unionByName(decode(whole, id_col, model=model) if decoded else whole)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """The id, token_ids and text of every row of an encoded table; no pieces are the empty text."""
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in slices(batches, 1):
            values, ends = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            ends = ends - ends[0]
            texts = [_text(p, values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, ids_col, "text"])

    return rows.mapInArrow(run, f"{id_col} {kind}, {ids_col} array<int>, text string")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, their count, and the digest of the text they decode to."""
    out = encode(table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", F.sha2("text", 256).alias("text_sha256"))
