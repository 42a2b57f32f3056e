"""SentencePiece encoding and decoding by a parallel max-plus scan.

Paths of pieces meet at each word's start, so a text's scan joins the best paths of its words, found
many at once and remembered (see ``word_paths``). A document above ``giant`` characters is cut into
chunks of ``chunk`` characters, anywhere, so that no task has to scan it alone. Each chunk gives its
boundary-state transfer matrix (see ``lattice``); matrices are multiplied in blocks, then over the
blocks of a document, and the best states go back to the blocks and chunks. Each chunk is then
backtraced on its own, from its entry state to its exit state. Only states and matrices meet, never
the text. The ids are the same either way.

Decoding maps each id on its own to bytes.

The model file is a parameter and is not trained. Its kind decides the weights: piece scores for a
unigram model, the merges' consistency for a BPE model, so that the ids are the model's own.

Cases: a null or empty text has no ids. A null id is passed on; repeated rows are encoded each time;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.llm.common import written
from mixtura.llm.lattice import SPACE, Lattice, Matrix, State, best_states, product
from mixtura.llm.word_paths import WordPaths

#: Chunks of a document whose matrices are multiplied together first.
BLOCK = 64


#: Texts of so many characters have their words' paths found together.
TOGETHER = 4 << 20
#: A word with the space marks before it.
_MARKED = re.compile(f"{SPACE}+[^{SPACE}]*")


class Model:
    def __init__(self, name: str, words: int = 400_000):
        import public_tokenizers
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        path = public_tokenizers.path(name)
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.lattice = Lattice({sp.id_to_piece(i): sp.get_score(i) for i in plain}, proto.trainer_spec.model_type == proto.trainer_spec.BPE)
        self._ids = {sp.id_to_piece(i): i for i in plain}
        self._bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.many = WordPaths(self.lattice, self._ids, self._bytes_of) if self.lattice.bpe and self.lattice.words else None
        #: What each id stands for in a decoded text.
        kept = frozenset(plain)
        self.parts = [sp.id_to_piece(i).replace(SPACE, " ").encode() if i in kept else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.decode([i]).encode() for i in range(sp.vocab_size())]
        self._memo: dict[str, bytes] = {}
        self._words = words

    def _bytes_of(self, char: str) -> list[int]:
        return [self._bytes[b] for b in char.encode("utf-8", "replace")]

    def ids_of(self, piece: str) -> list[int]:
        """The id of a piece; of a character outside the vocabulary, its bytes' ids."""
        return [self._ids[piece]] if piece in self._ids else self._bytes_of(piece)

    def _path(self, word: str) -> bytes:
        pieces = self.lattice.trace(self.lattice.paths(word, 0, "", len(word)), len(word))
        return np.array([i for p in pieces for i in self.ids_of(p)], dtype="<u4").tobytes()

    def packed_marked(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that begin with a word's space mark."""
        if not self.lattice.words:
            return [self._path(t) for t in texts]
        parts = [_MARKED.findall(t) for t in texts]
        if len(self._memo) > self._words:
            self._memo.clear()
        memo = self._memo
        new = [w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in memo]
        if self.many:
            memo.update(self.many.paths(new))
        for w in new:
            if w not in memo:
                memo[w] = self._path(w)
        return [b"".join(map(memo.__getitem__, p)) for p in parts]

    def packed(self, texts: list[str]) -> list[bytes]:
        return self.packed_marked([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])

    def weight_marked(self, text: str) -> float:
        if self.lattice.bpe:
            return 0.0
        return float(sum(self.sp.get_score(int(i)) for i in np.frombuffer(self.packed_marked([text])[0], dtype="<u4")))

    def text_of(self, ids: bytes) -> str:
        return b"".join(map(self.parts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")[1:]


_models: dict[str, Model] = {}


def model_of(name: str) -> Model:
    """The model, kept by a Python worker from task to task."""
    if name not in _models:
        _models[name] = Model(name)
    return _models[name]


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows of some ``most`` in all."""
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _key(s: State) -> str:
    return f"{s[0]} {s[1]}"


def _state(key: str) -> State:
    ahead, _, piece = key.partition(" ")
    return int(ahead), piece


def dumped(m: Matrix) -> str:
    return json.dumps({_key(s): {_key(e): w for e, w in row.items()} for s, row in m.items()})


def loaded(text: str) -> Matrix:
    return {_state(s): {_state(e): w for e, w in row.items()} for s, row in json.loads(text).items()}


_CHUNK = "uid long, doc_id long, k long, chunks long, behind string, text string, size long"


def _chunked(chunk: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                marked = SPACE + text.replace(" ", SPACE)
                starts = range(0, len(marked), chunk)
                for k, i in enumerate(starts):
                    size = min(chunk, len(marked) - i)
                    row = ([uid], [doc_id], [k], [len(starts)], [marked[max(0, i - reach) : i]], [marked[i : i + size + reach]], [size])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["uid", "doc_id", "k", "chunks", "behind", "text", "size"])

    return run


def _products(group: pd.DataFrame) -> pd.DataFrame:
    total = None
    for text in group.sort_values("k").matrix:
        total = loaded(text) if total is None else product(total, loaded(text))
    return pd.DataFrame({"uid": [group.uid.iloc[0]], "block": [group.block.iloc[0]], "matrix": [dumped(total)]})


def _block_states(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("block")
    states = best_states([loaded(x) for x in group.matrix], (0, ""), _last_state(loaded(group.matrix.iloc[-1])))
    return pd.DataFrame({"uid": group.uid, "block": group.block, "begin": [_key(s) for s in states[:-1]], "end": [_key(s) for s in states[1:]]})


def _last_state(m: Matrix) -> State:
    """At the end of a text nothing lies ahead; the piece that ends there follows from the start."""
    ends = {e for row in m.values() for e in row if e[0] == 0}
    return next(iter(ends)) if len(ends) == 1 else (0, _END)


#: Stands for whichever piece ends the text, where matrices know of several.
_END = "\x00"


def _closed(m: Matrix) -> Matrix:
    """The last chunk's matrix: only paths that end with the text, in one common state."""
    return {s: {(0, _END): max(w for e, w in row.items() if e[0] == 0)} for s, row in m.items() if any(e[0] == 0 for e in row)}


def _chunk_states(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("k")
    states = best_states([loaded(x) for x in group.matrix], _state(group.begin.iloc[0]), _state(group.end.iloc[0]))
    return pd.DataFrame({"uid": group.uid, "k": group.k, "entry": [_key(s) for s in states[:-1]], "exit": [_key(s) for s in states[1:]]})


def _giant_ids(giants: DataFrame, model: str, chunk: int, then: Callable, schema: str) -> DataFrame:
    """(doc_id, ids) of giant documents, (uid, doc_id, text), as ``then`` makes them."""
    reach = model_of(model).lattice.longest
    chunks = written(giants.mapInArrow(_chunked(chunk, reach), _CHUNK), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            out = []
            for k, n, behind, text, size in zip(*(batch.column(c).to_pylist() for c in ("k", "chunks", "behind", "text", "size"))):
                one = m.lattice.transfer(behind, text, size, m.weight_marked)
                out.append(dumped(_closed(one) if k == n - 1 else one))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("k"), pa.array(out, pa.string())], names=["uid", "k", "matrix"])

    made = written(chunks.mapInArrow(matrices, "uid long, k long, matrix string").withColumn("block", F.expr(f"k div {BLOCK}")), "transfer-matrices")
    # Matrices are small, but their products are work: Spark is not to bring them into few tasks.
    made = made.repartition(int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uid", "block")
    blocks = made.groupBy("uid", "block").applyInPandas(_products, "uid long, block long, matrix string")
    begins = blocks.groupBy("uid").applyInPandas(_block_states, "uid long, block long, begin string, end string")
    states = made.join(begins, ["uid", "block"]).groupBy("uid", "block").applyInPandas(_chunk_states, "uid long, k long, entry string, exit string")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            for i, j in _slices(batch.column("size").to_pylist(), TOGETHER):
                part = batch.slice(i, j - i)
                rows = zip(*(part.column(c).to_pylist() for c in ("behind", "text", "size", "entry", "exit")))
                found = [m.lattice.backtrace(behind, text, size, _state(entry), _state(exit_), str) for behind, text, size, entry, exit_ in rows]
                # The whole words within all these chunks are found together.
                words = iter(m.packed_marked([x for parts in found for x in parts if isinstance(x, str)]))
                out = [b"".join(next(words) if isinstance(x, str) else np.array([k for p in x for k in m.ids_of(p)], dtype="<u4").tobytes() for x in parts) for parts in found]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), part.column("k"), pa.array(out, pa.binary())], names=["uid", "doc_id", "k", "ids"])

    parts = chunks.join(states, ["uid", "k"]).select("uid", "doc_id", "k", "behind", "text", "size", "entry", "exit").mapInArrow(traced, "uid long, doc_id long, k long, ids binary")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, own in zip(batch.column(0), batch.column(1)):
                k, ids = own.values.flatten()
                joined = b"".join(ids.take(pa.array(np.argsort(k.to_numpy()))).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([joined], pa.binary())], names=["doc_id", "ids"])

    return parts.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("k", "ids")).alias("parts")).select("doc_id", "parts").mapInArrow(lambda batches: then(whole(batches)), schema)


_IDS = "doc_id long, ids binary"


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", giant: int = 32_768, chunk: int = 8_192, text_col: str = "text", id_col: str = "doc_id", then: Callable = iter, schema: str = _IDS) -> DataFrame:
    """doc_id and ids (unsigned 32-bit, little-endian, packed) for each row of ``docs``. ``then`` makes
    batches of ``schema`` of these in the same Python worker, so that a task holds the model once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _slices(list(map(len, texts)), TOGETHER):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(m.packed(texts[i:j]), pa.binary())], names=["doc_id", "ids"])

    giants = rows.filter(F.length("text") > giant).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return rows.filter(F.length("text") <= giant).mapInArrow(lambda batches: then(encoded(batches)), schema).unionByName(_giant_ids(giants, model, chunk, then, schema))


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text from (doc_id, ids)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            texts = list(map(m.text_of, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")


def sentencepiece_digest(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_pieces, ids_sha256, and decoded_sha256 of the text that the ids decode to."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = [(len(ids) // 4, sha(ids), sha(m.text_of(ids).encode())) for ids in batch.column(1).to_pylist()]
            n, ids, text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_pieces", "ids_sha256", "decoded_sha256"])

    return encode(docs, model, then=digested, schema="doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string")
