"""BPE encoding and decoding by forced-boundary splitting, with the vocabulary and rules of a public tokenizer file.

A byte pair that occurs inside no vocabulary token can never be merged across, so it is a certain cut: the fragments
between such cuts are encoded independently and their ids are concatenated. White space is a certain cut as well, for the
pre-tokenizer drops it. Texts are therefore cut at white space into chunks, chunks into words, and words into fragments;
results of chunks and words are remembered per worker in bounded tables, for natural text repeats them.

The file's special tokens are cut out of the raw text first. Null and empty texts give no ids and an empty decoded text.
A fragment of any length is merged with a heap, in n log n. Decoding reads ids alone: Arrow takes each id's token and joins them.

Repeated rows are encoded each. Columns of the input named like a new one give way; others pass through. An empty table stays empty.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns

CHUNKS_KEPT, WORDS_KEPT, LONGEST_KEPT, FEW = 250_000, 250_000, 64, 24
PORTION = 1_000_000
NEVER = 1 << 60
#: Code points that str.split() takes for white space and the tokenizer's \s does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
CHUNK = regex.compile(r"\P{White_Space}+")
# Letters and digits (first, last) that the regex module knows and the tokenizer, of an earlier Unicode version, doesn't.
LATER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LATER_DIGITS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
# Capitals (first, last, first small letter) that the tokenizer lower-cases and Python's older tables don't.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
# Marks (first, last) that Python reorders or composes and the tokenizer, whose composition is that of Unicode 9, leaves where they are.
LATER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938),
    (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
LOWER_LATER = {a + i: chr(small + i) for a, b, small in LATER_CAPITALS for i in range(b - a + 1)}


def class_of(ranges) -> str:
    """A set of code points for the regex module."""
    return "[" + "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in ranges) + "]"


INERT = regex.compile("(" + class_of(LATER_MARKS) + ")")
LATER = regex.compile(class_of((*LATER_LETTERS, *LATER_DIGITS, *((a, b) for a, b, _ in LATER_CAPITALS))))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1 bytes are themselves, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Kept(dict):
    """A dictionary that starts over when it holds ``most`` entries."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def put(self, key, value):
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Filled(Kept):
    """The same, with a function that makes what is missing."""

    def __init__(self, most: int, make):
        super().__init__(most)
        self.make = make

    def __missing__(self, key):
        return self.make(key)


class Vocabulary:
    """What the tokenizer file says, ready for use in a worker."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.token_texts = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[left, right] = (rank, left + right)
        self.rank_of = {pair: rank for pair, (rank, _) in self.ranks.items()}
        self.alphabet = byte_alphabet()
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        inside = set()
        for token in self.ids:
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) and token != self.suffix else token
            inside.update(zip(body, body[1:], strict=False))
        self.joinable = inside
        # Chunks hold no white space and are lower case: for ASCII the pattern's classes are plain ranges.
        self.ascii_words = re.compile(self.words.pattern.replace(r"\p{White_Space}", "").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        # For the rare chunks with code points that only one side knows.
        older = self.words.pattern.replace(r"\p{L}", rf"[\p{{L}}--{class_of(LATER_LETTERS)}]").replace(r"\p{N}", rf"[\p{{N}}--{class_of(LATER_DIGITS)}]")
        self.older_words = regex.compile(older, regex.V1)
        self.known_words = Kept(WORDS_KEPT)
        self.chunks = Filled(CHUNKS_KEPT, self.chunk)

    def normalized(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        if INERT.search(chunk):
            chunk = "".join(unicodedata.normalize("NFC", part) for part in INERT.split(chunk))
        else:
            chunk = unicodedata.normalize("NFC", chunk)
        if LATER.search(chunk):
            chunk = chunk.translate(LOWER_LATER)
        # Character by character: str.lower() has a rule for a sigma at the end of a word.
        return "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()

    def cuts(self, word: str) -> Iterator[tuple[str, bool]]:
        """The fragments of a word in byte letters, and whether each ends the word."""
        if self.joinable.issuperset(zip(word, word[1:], strict=False)):
            yield word, True
            return
        start = 0
        for i in range(1, len(word)):
            if (word[i - 1], word[i]) not in self.joinable:
                yield word[start:i], False
                start = i
        yield word[start:], True

    def merge_few(self, symbols: list[str]) -> list[str]:
        """The same as merge() with the ranks of all pairs in a list, which is quicker for a few."""
        get = self.rank_of.get
        ranks = [get(pair, NEVER) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), NEVER)
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), NEVER)
        return symbols

    def merge(self, symbols: list[str]) -> list[str]:
        """Lowest rank first, leftmost of equals."""
        n, ranks = len(symbols), self.ranks
        if n < 2:
            return symbols
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = ranks[left, right][1], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := ranks.get((symbols[i], symbols[k])):
                    heapq.heappush(heap, (r[0], i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))):
                heapq.heappush(heap, (r[0], h, symbols[h], symbols[i]))
        return [s for s in symbols if s is not None]

    def word(self, word: str) -> bytes:
        """Ids of one pre-tokenized word, packed."""
        letters = word if word.isascii() and word.isprintable() else "".join(map(self.alphabet.__getitem__, word.encode()))
        tokens: list[str] = []
        for fragment, last in self.cuts(letters):
            symbols = list(fragment)
            if last:
                symbols[-1] += self.suffix
            tokens += self.merge_few(symbols) if len(symbols) <= FEW else self.merge(symbols)
        packed = struct.pack(f"<{len(tokens)}I", *map(self.ids.__getitem__, tokens))
        return self.known_words.put(word, packed) if len(word) <= LONGEST_KEPT else packed

    def chunk(self, chunk: str) -> bytes:
        """The same for a text without white space."""
        if chunk in self.special:
            return self.chunks.put(chunk, struct.pack("<I", self.special[chunk]))
        text, kept = self.normalized(chunk), self.known_words
        pattern = self.ascii_words if text.isascii() else self.older_words if LATER.search(text) else self.words
        found = [kept.get(w) or self.word(w) for w in pattern.findall(text)]
        packed = found[0] if len(found) == 1 else b"".join(found)
        return self.chunks.put(chunk, packed) if len(chunk) <= LONGEST_KEPT else packed

    def decode(self, packed: list[bytes]) -> pa.Array:
        """The texts of lists of ids: their tokens with a space between, for the file has no decoder."""
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
        tokens = pc.take(self.token_texts, pa.array(np.frombuffer(b"".join(packed), "<u4")))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens), " ")

    def pieces(self, text: str) -> list[str]:
        """A text cut at white space, and around special tokens, which stand alone."""
        out = []
        for piece in self.special_cut.split(text) if any(x in text for x in self.special) else [text]:
            if piece in self.special:
                out.append(piece)
            else:
                out += CHUNK.findall(piece) if any(c in piece for c in NOT_SPACE) else piece.split()
        return out

    def encode(self, texts: list[str]) -> pa.Array:
        """Packed ids of whole texts.

        Arrow numbers the distinct chunks of the texts, each is encoded once, and Arrow joins the results text by text.
        """
        chunks, ends = [], [0]
        for text in texts:
            chunks += self.pieces(text)
            ends.append(len(chunks))
        coded = pa.array(chunks, pa.string()).dictionary_encode()
        found = list(map(self.chunks.__getitem__, coded.dictionary.to_pylist()))
        each = pc.take(pa.array(found, pa.binary()), coded.indices)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pa.scalar(b"", pa.binary()))


_LOADED: dict[int, Vocabulary] = {}


def vocabulary(shared) -> Vocabulary:
    """One per worker and file."""
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(shared.value)
    return _LOADED[key]


def shared_file(df: DataFrame, path: str):
    """The tokenizer file (a few MB), read once by the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def portions(column: pa.Array, empty) -> Iterator[list]:
    """Runs of texts, or packed ids, of about PORTION bytes; only one run at a time is held as Python objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.flatnonzero(np.diff(ends // PORTION, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(column)], strict=False):
        yield [x or empty for x in column.slice(a, b - a).to_pylist()]


def encode_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``."""
    from pyspark.sql.functions import arrow_udf

    shared = shared_file(docs, tokenizer_path)

    @arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        found = [vocabulary(shared).encode(part) for part in portions(texts, "")]
        return pa.concat_arrays(found) if found else pa.array([], pa.binary())

    return with_columns(docs, encode(F.col(text_col)), lambda ids: {"ids": ids, "n_tokens": (F.octet_length(ids) / 4).cast("long")})


def decode_documents(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, from packed ids alone; null ids decode to an empty text."""
    from pyspark.sql.functions import arrow_udf

    shared = shared_file(encoded, tokenizer_path)

    @arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        found = [vocabulary(shared).decode(part) for part in portions(ids, b"")]
        return pa.concat_arrays(found) if found else pa.array([], pa.string())

    return with_columns(encoded, decode(F.col(ids_col)), lambda text: {"decoded": text})


def round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded``, which is made from the ids.

    Both steps are one function here: chained ones would be fused, and every text encoded twice.
    """
    from pyspark.sql.functions import arrow_udf

    shared = shared_file(docs, tokenizer_path)

    @arrow_udf("struct<ids:binary,decoded:string>")
    def there_and_back(texts: pa.Array) -> pa.Array:
        v, out = vocabulary(shared), []
        for part in portions(texts, ""):
            ids = v.encode(part)
            out.append(pa.StructArray.from_arrays([ids, v.decode(ids.to_pylist())], ["ids", "decoded"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("ids", pa.binary()), ("decoded", pa.string())]))

    made = lambda x: {"ids": x["ids"], "n_tokens": (F.octet_length(x["ids"]) / 4).cast("long"), "decoded": x["decoded"]}
    return with_columns(docs, there_and_back(F.col(text_col)), made)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Every row's ids, encoded and then decoded again, as digests."""
    out = round_trip(docs.select("doc_id", "text"), tokenizer_path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digests(table(spark, sf_dir, "documents"), tokenizer_path())
