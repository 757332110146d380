"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

A merge of two neighbours can only be prevented by a better merge that takes one of
them away, which in turn needs symbols further right, and so on with ever better
merges. ``sufficient_lookahead`` follows these chains through the merge list and
gives the number of symbols after which nothing to the right can change a token.
The encoder holds a window, merges inside it, emits every token that ends at least
that far from the window's end and goes on behind it, so memory does not grow with
the length of a run of letters. Decoding is a state machine over bytes that emits
text as soon as a code point is complete.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.blocks import text_or_empty

# White space of Unicode; unlike str.split it leaves out the separators 28 to 31.
WHITE = "\t-\r \x85\xa0  -     　"
BLOCK = 1 << 20
CACHE_ENTRIES = 1 << 19
CACHED_LENGTH = 64


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str = "") -> int:
    """Symbols right of a token's end that decide whether the token stays.

    ``need[t]`` is that number for token t after the merges seen so far: a merge
    (x, y) leaves the token xy with the need of y, and can take x away wherever y
    follows, so x needs to see y and what y needs. One pass, best merge first.
    """
    need: dict[str, int] = {}
    for x, y in merges:
        width = len(y.removesuffix(suffix)) if suffix else len(y)
        behind = need.get(y, 0)
        need[x] = max(need.get(x, 0), width + behind)
        need[x + y] = max(need.get(x + y, 0), behind)
    return max(need.values(), default=0)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeList:
    """A tokenizer file: normaliser, splitting pattern, merges and vocabulary."""

    def __init__(self, file: dict):
        model = file["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.lookahead = sufficient_lookahead(pairs, self.suffix)
        self.longest = max((len(t) for t in self.vocab), default=1)
        self.window = 2 * (self.lookahead + self.longest) + 2
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        self.special_mark = commonprefix(list(self.special))
        self.special_at = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        normal = file.get("normalizer") or {}
        kinds = [n["type"] for n in normal.get("normalizers", [normal] if normal else [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]"))
        self.symbols = byte_symbols()
        self.pieces = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # without a decoder in the file tokens are joined by blanks, with one their bytes are joined
        self.joins_bytes = (file.get("decoder") or {}).get("type") == "ByteLevel"

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges inside ``symbols``, best first, leftmost first."""
        rank, none = self.rank.get, len(self.rank)
        parts = list(symbols)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), none)
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
        return parts

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a stream of symbols, each emitted once nothing can change it.

        The last symbol carries the end-of-word mark, so one symbol is held back.
        """
        held: list[str] = []
        ahead = None
        for symbol in symbols:
            if ahead is not None:
                held.append(ahead)
                if len(held) >= self.window:
                    stable, done = len(held) - self.lookahead, 0
                    for token in self.merged(held):
                        if done + len(token) > stable:
                            break
                        done += len(token)
                        yield token
                    del held[:done]
            ahead = symbol
        if ahead is not None:
            held.append(ahead + self.suffix)
            yield from self.merged(held)

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text) if self.nfc else text
        if not self.lower:
            return text
        # character by character: a sigma at the end of a word stays a common sigma
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def words(self, piece: str) -> list[str]:
        """What the pattern splits a stretch without white space into."""
        if piece.isascii() and piece.isalpha():
            return [self.normal(piece)]
        return self.pattern.findall(self.normal(piece))

    def word_ids(self, word: str) -> bytes:
        """Ids of one word, as 32-bit little-endian bytes."""
        symbols = list(map(self.symbols.__getitem__, word.encode()))
        if len(symbols) < self.window:  # one window holds it: nothing is left to wait for
            symbols[-1] += self.suffix
            tokens = self.merged(symbols)
        else:
            tokens = self.stream(symbols)
        return array("I", map(self.vocab.__getitem__, tokens)).tobytes()

    def split_special(self, piece: str) -> Iterator[str | int]:
        """A stretch without white space, with special tokens cut out as ids."""
        done = 0
        for match in self.special_at.finditer(piece):
            yield piece[done : match.start()]
            yield self.special[match.group()]
            done = match.end()
        yield piece[done:]


class WordCache(dict):
    """Ids of words; emptied when full, long words are not kept."""

    def __init__(self, merges: MergeList):
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> bytes:
        ids = self.merges.word_ids(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = ids
        return ids


class PieceCache(dict):
    """Ids of stretches between white space; emptied when full, long stretches are not kept."""

    def __init__(self, merges: MergeList):
        super().__init__()
        self.merges = merges
        self.of_words = WordCache(merges)

    def plain(self, piece: str) -> bytes:
        words = self.merges.words(piece)
        return self.of_words[words[0]] if len(words) == 1 else b"".join(map(self.of_words.__getitem__, words))

    def __missing__(self, piece: str) -> bytes:
        if self.merges.special and self.merges.special_mark in piece:
            ids = b"".join(
                array("I", [x]).tobytes() if isinstance(x, int) else self.plain(x) for x in self.merges.split_special(piece)
            )
        else:
            ids = self.plain(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


_WHITE_RUN = regex.compile(f"[{WHITE}]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in blocks that end before white space."""
    start, n = 0, len(text)
    while n - start > size:
        cut = _WHITE_RUN.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, cache: PieceCache) -> Iterator[bytes]:
    """Ids of a text, block by block, as 32-bit little-endian bytes."""
    for block in blocks(text):
        pieces = _WHITE_RUN.split(block) if _SEPARATORS.search(block) else block.split()
        yield b"".join(map(cache.__getitem__, filter(None, pieces)))


class TextDecoder:
    """Byte-to-text state machine: keeps the bytes of an unfinished code point between calls."""

    def __init__(self, merges: MergeList, table: list[bytes] | None = None):
        self.table = table or byte_table(merges)
        self.glue = b"" if merges.joins_bytes else b" "
        self.started = False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = self.glue.join(map(self.table.__getitem__, ids))
        if data:
            data = self.glue + data if self.started else data
            self.started = True
        return self.state.decode(data)

    def end(self) -> str:
        return self.state.decode(b"", True)


def byte_table(merges: MergeList) -> list[bytes]:
    """Bytes of each id."""
    to_byte = {c: b for b, c in enumerate(merges.symbols)}
    table = [b""] * (max(merges.pieces) + 1)
    for i, token in merges.pieces.items():
        if merges.joins_bytes and i not in merges.special.values():
            table[i] = bytes(to_byte[c] for c in token)
        else:
            table[i] = token.encode()
    return table


@lru_cache(maxsize=2)
def _loaded(file_name: str) -> tuple[MergeList, list[bytes], PieceCache]:
    with open(SparkFiles.get(file_name), encoding="utf-8") as f:
        merges = MergeList(json.load(f))
    return merges, byte_table(merges), PieceCache(merges)


def _digest(file_name: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, table, cache = _loaded(file_name)
        for batch in batches:
            counts, id_shas, text_shas = [], [], []
            for text in batch.column("text"):
                n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), TextDecoder(merges, table)
                for part in encode(text.as_py(), cache):
                    n += len(part) // 4
                    of_ids.update(part)
                    of_text.update(decoder.feed(array("I", part)).encode())
                of_text.update(decoder.end().encode())
                counts.append(n)
                id_shas.append(of_ids.hexdigest())
                text_shas.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_shas), pa.array(text_shas)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return task


def _encode_ids(file_name: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _loaded(file_name)[2]
        for batch in batches:
            ids = [array("I", b"".join(encode(t.as_py(), cache))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(list, ids), pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return task


def _decode_ids(file_name: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, table, _ = _loaded(file_name)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                decoder = TextDecoder(merges, table)
                texts.append(decoder.feed(ids.as_py() or ()) + decoder.end())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return task


def _ship_file(df: DataFrame, path: str) -> str:
    """Hand the tokenizer file to the executors, once per context."""
    context = df.sparkSession.sparkContext
    if path not in {p.removeprefix("file:").replace("//", "/") for p in context.listFiles}:
        context.addFile(path)
    return path.rsplit("/", 1)[-1]


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every text; null text has no ids. One row per input row, no shuffle."""
    name = _ship_file(docs, tokenizer)
    return _input(docs, id_col, text_col).mapInArrow(_encode_ids(name), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text."""
    name = _ship_file(encoded, tokenizer)
    return encoded.select("doc_id", "ids").mapInArrow(_decode_ids(name), "doc_id long, text string")


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the digests of no bytes. Texts of any
    length pass in blocks. Repeated rows are encoded each for itself; other columns
    are not read. An empty table gives no rows.
    """
    name = _ship_file(docs, tokenizer)
    return _input(docs, id_col, text_col).mapInArrow(
        _digest(name), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
