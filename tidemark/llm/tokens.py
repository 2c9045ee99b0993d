"""Token counts, packing and grammar-compressed token files.

Two encoders are used, both held to the tokenizers library by tests:

* byte-level BPE (byte_bpe_50k): tiktoken with the same vocabulary as ranks and a
  possessive spelling of the same pattern, which runs without backtracking;
* word BPE (word_bpe_49k): each word, marked by a byte that UTF-8 never has, is merged
  by tiktoken; the marked byte pairs have the lowest ranks, so they merge first, as the
  library's end-of-word suffix does.  Texts with characters outside SETTLED go to the
  tokenizers library itself, whose Unicode tables decide on them.

Files are opened by path on each worker; only the path travels.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ID, TAG, cache, keyed, lean

# Fixed values of the public vocabularies.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = " \t\n\r\x0b\x0c\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: characters of which case, normal form and class are the same in all versions of Unicode that are in use
SETTLED = "\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
#: entries that an encoder's cache may hold
CACHE = 400_000


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str):
    """(core, special strings) of the byte-level BPE in the .tiktoken file or .json file at path."""
    import tiktoken

    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": len(ranks)}
    else:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        back = _byte_letters()
        ranks = {bytes(back[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in special}
    made = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return made._core_bpe, set(special)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of a text under the lower-casing word BPE, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.special = {x["content"]: array("I", [x["id"]]).tobytes() for x in whole["added_tokens"]}
        self.size = 1 + max([*whole["model"]["vocab"].values(), *(x["id"] for x in whole["added_tokens"])])
        back, ranks = _byte_letters(), {}
        for token, i in whole["model"]["vocab"].items():
            if token not in self.special:
                last = token.endswith("</w>")
                ranks[bytes(back[c] for c in (token[:-4] if last else token)) + b"\xff" * last] = i
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(WORD_PATTERN).findall
        self.split = re.compile(f"[{WHITE}]+").split
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        piece = self.piece
        if word.isascii() and (word.isalpha() or (word[-1] in ".,!?" and word[:-1].isalpha())):
            ids = piece(word.encode() + b"\xff") if word.isalpha() else piece(word[:-1].encode() + b"\xff") + piece(word[-1].encode() + b"\xff")
        else:
            ids = []
            for p in self.pieces(word):
                ids += piece(p.encode() + b"\xff")
        made = array("I", ids).tobytes()
        if len(self.known) < CACHE:
            self.known[word] = made
        return made

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        found = text.split() if not _CONTROL(text) else [w for w in self.split(text) if w]
        known, word = self.known.get, self.word
        return b"".join([known(w) or word(w) for w in found])

    def __call__(self, text: str) -> bytes:
        if not text.isascii() and _UNSETTLED(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if "<|" not in text:
            return self.plain(text)
        return b"".join(self.special.get(x) or self.plain(x) for x in self.cut(text))


_CONTROL = re.compile("[\x1c-\x1f]").search
_UNSETTLED = re.compile(f"[^{SETTLED}]").search


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


cache("byte encoder", byte_encoder.cache_clear)
cache("word encoder", word_encoder.cache_clear)

# ---------------------------------------------------------------- counts


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """(_id, n_bytes, n_tokens, n_pretokens, over_limit), one row for each row of docs.

    A pre-token is a run of white space with the run of other characters after it: no
    token of the byte-level pattern crosses its end, so pieces of pre-tokens add up.
    Each block of texts forms the distinct pre-tokens of its texts, counts the pieces of
    each once, joins these counts to the pre-token frequencies of each text and sums.
    The join is within the block, so nothing is shuffled, and no ids are kept.

    Null and empty texts have 0 bytes and tokens; repeated rows give repeated rows; an
    empty table gives an empty one; further columns are left out.
    """
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    base = keyed(docs, id_col, text_col)
    kind = base.schema[ID].dataType.simpleString()
    pattern = f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, special = byte_encoder(path)
        split, pieces = re.compile(pattern).findall, {}
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column(2).to_pylist()
                frequency = [Counter(split(t)) for t in texts]
                if len(pieces) > CACHE:
                    pieces = {}
                for p in set().union(*frequency).difference(pieces):
                    pieces[p] = len(core.encode(p, special))
                n = [sum(k * pieces[p] for p, k in f.items()) for f in frequency]
                size = pc.binary_length(part.column(2)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), pa.array([f.total() for f in frequency], pa.int64())], names=[ID, "n_bytes", "n_tokens", "n_pretokens"])

    return base.mapInArrow(lean(run, "byte encoder"), f"{ID} {kind}, n_bytes long, n_tokens long, n_pretokens long").withColumn("over_limit", F.col("n_tokens") > limit)


# ---------------------------------------------------------------- packing


def binary_pieces(n: int, top: int) -> list[int]:
    """Lengths, all powers of two up to top, that add up to n: the longest first."""
    out = [top] * (n // top)
    rest = n % top
    while rest:
        piece = 1 << (rest.bit_length() - 1)
        out.append(piece)
        rest -= piece
    return out


def packed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, top: int = 1024, end_id: int = 0) -> DataFrame:
    """(_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    The ids of a text, with end_id after them, are cut into pieces of binary length, the
    longest first.  Each piece is a sequence of its own in the bucket of its length, so no
    sequence crosses documents and, at powers of two, none has padding.  Batches are formed
    within a bucket; sequence_id is bucket-major: bits 58 to 62 are the length's exponent,
    below them a number that Spark makes unique, so no shuffle is needed.

    Null and empty texts are the end id alone; repeated rows give pieces of their own; an
    empty table gives an empty one; further columns are left out.
    """
    if top & (top - 1):
        raise ValueError("top must be a power of two")
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    base = keyed(docs, id_col, text_col)
    kind = base.schema[ID].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, special = byte_encoder(path)
        end = array("I", [end_id]).tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                row, start, length, ids, crc, total = [], [], [], [], [], []
                for i, text in enumerate(b.column(2).slice(lo, 256)):
                    raw = bytes(core.encode_to_tiktoken_buffer(text.as_py(), special)) + end
                    n, at = len(raw) // 4, 0
                    for k in binary_pieces(n, top):
                        piece = raw[4 * at : 4 * (at + k)]
                        row.append(lo + i)
                        start.append(at)
                        length.append(k)
                        ids.append(piece)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        at += k
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())],
                    names=[ID, "start", "length", "ids", "ids_crc32", "doc_tokens"],
                )

    made = base.mapInArrow(lean(run, "byte encoder"), f"{ID} {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long")
    bucket = F.expr("shiftleft(cast(round(log2(length)) as long), 58)")
    return made.withColumns({"sequence_id": bucket.bitwiseOR(F.monotonically_increasing_id()), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the rows of packed_pieces as Parquet, one folder for each sequence length.

    Nulls, repeated rows and further columns are written as they are; an empty table gives a folder without files of rows.
    """
    pieces.write.partitionBy("length").parquet(path)


# ---------------------------------------------------------------- grammar files

#: ids in a shard, at least, but for the last of a partition
SHARD_IDS = 1 << 20
#: pairs that a round replaces, and the fewest occurrences of one
ROUND_PAIRS, LEAST = 4096, 12


def repair(ids: np.ndarray, first_rule: int, end_id: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, left, right) of a Re-Pair grammar: rule k is first_rule + k -> left[k] right[k].

    Each round replaces the most frequent pairs of neighbours at once, from left to right
    without overlap, by new nonterminals; symbols fit 16 bits.  No pair starts with end_id,
    so each document is a run of whole symbols.  Ids must be below first_rule, and that no
    more than 65536: other vocabularies raise ValueError.
    """
    if first_rule > 1 << 16 or len(ids) and int(ids.max()) >= first_rule:
        raise ValueError(f"ids must be below {first_rule}, the first rule, and symbols fit 16 bits")
    seq = ids.astype(np.uint16)
    left, right = [], []
    for _ in range(rounds):
        free = 65536 - first_rule - len(left)
        if free <= 0 or len(seq) < 2 * LEAST:
            break
        pair = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
        can = seq[:-1] != end_id
        ordered = np.sort(pair[can])
        cut = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[cut, len(ordered)])
        often = np.flatnonzero(count >= LEAST)
        if not len(often):
            break
        best = often[np.argsort(-count[often], kind="stable")[: min(ROUND_PAIRS, free)]]
        rules = np.sort(ordered[cut[best]])
        # each pair's rule, by a table over the left and right symbols that rules have
        a, row = np.unique(rules >> np.uint32(16), return_inverse=True)
        b, col = np.unique(rules & np.uint32(0xFFFF), return_inverse=True)
        table = np.full((len(a) + 1, len(b) + 1), -1, dtype=np.int16)
        table[row, col] = np.arange(len(rules))
        rows, cols = np.full(65536, len(a), dtype=np.int16), np.full(65536, len(b), dtype=np.int16)
        rows[a], cols[b] = np.arange(len(a)), np.arange(len(b))
        found = table[rows[seq[:-1]], cols[seq[1:]]]
        at = np.flatnonzero((found >= 0) & can)
        k = found[at].astype(np.int64)
        fresh = np.r_[True, at[1:] != at[:-1] + 1] if len(at) else np.zeros(0, bool)
        run = np.flatnonzero(fresh)
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at, k = at[place % 2 == 0], k[place % 2 == 0]
        seq[at] = (first_rule + len(left) + k).astype(np.uint16)
        gone = np.ones(len(seq), dtype=bool)
        gone[at + 1] = False
        seq = seq[gone]
        left.extend((rules >> np.uint32(16)).tolist())
        right.extend((rules & np.uint32(0xFFFF)).tolist())
    return seq, np.array(left, dtype=np.uint16), np.array(right, dtype=np.uint16)


def rule_lengths(left: np.ndarray, right: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each rule stands for."""
    out = np.ones(first_rule + len(left), dtype=np.uint32)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[first_rule + k] = out[a] + out[b]
    return out[first_rule:]


class Shard:
    """Random access to the ids of a shard."""

    def __init__(self, seq: bytes, left: bytes, right: bytes, lengths: bytes, first_rule: int):
        self.seq = np.frombuffer(seq, dtype="<u2")
        a, b, n = np.frombuffer(left, "<u2").tolist(), np.frombuffer(right, "<u2").tolist(), np.frombuffer(lengths, "<u4")
        self.first_rule = first_rule
        self.span = np.r_[np.ones(first_rule, dtype=np.int64), n.astype(np.int64)]
        whole: list[np.ndarray] = []
        unit = np.arange(first_rule, dtype=np.uint32)
        of = lambda s: unit[s : s + 1] if s < first_rule else whole[s - first_rule]
        for x, y in zip(a, b, strict=True):
            whole.append(np.concatenate((of(x), of(y))))
        self.flat = np.concatenate([unit, *whole])
        self.at = np.cumsum(self.span) - self.span
        self.ends = np.cumsum(self.span[self.seq])

    def ids(self, start: int, n: int) -> np.ndarray:
        """The n ids from the start-th on; only the symbols that cover them are expanded."""
        i, j = np.searchsorted(self.ends, [start, start + n - 1], side="right")
        some = self.seq[i : j + 1]
        span = self.span[some]
        place = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        out = self.flat[np.repeat(self.at[some], span) + place]
        skip = start - (int(self.ends[i - 1]) if i else 0)
        return out[skip : skip + n]


FILE_SCHEMA = "part int, shard int, first long, n_ids long, first_rule int, seq binary, lefts binary, rights binary, lengths binary, doc_start array<long>, doc_n array<long>"


def write_grammar(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, rounds: int = 4) -> None:
    """Write the ids of all texts, end_id after each, in ascending order of ids as grammar shards.

    The file format is Parquet with a row for each shard: place (part, shard), ids before it
    in its part, rules as left and right symbols with their expansion lengths, the symbol
    sequence, and for each document its id, place and number of ids.  Spark's writer commits
    whole tasks, so lost executors leave no half-written shards.

    Ties of the id are ordered by the text's hash and the text, a null id comes first; null
    texts count as empty (end_id alone); an empty table gives no shard; further columns are
    left out.
    """
    tokenizer = tokenizer or vocabulary("word_bpe_49k.json")
    base = keyed(docs, id_col, text_col)
    kind = base.schema[ID].dataType.simpleString()
    ordered = base.repartitionByRange(ID, TAG).sortWithinPartitions(ID, TAG, "_text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        end, first_rule = array("I", [end_id]).tobytes(), max(encode.size, end_id + 1)
        keys: list = []
        texts: list[bytes] = []
        held = shard = before = part = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, texts, held, shard, before
            n = np.array([len(t) // 4 for t in texts], dtype=np.int64)
            seq, left, right = repair(np.frombuffer(b"".join(texts), dtype=np.uint32), first_rule, end_id, rounds)
            row = [part, shard, before, held, first_rule, seq.tobytes(), left.tobytes(), right.tobytes(), rule_lengths(left, right, first_rule).astype("<u4").tobytes(), (np.cumsum(n) - n).tolist(), n.tolist()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["part", "shard", "first", "n_ids", "first_rule", "seq", "lefts", "rights", "lengths", "doc_start", "doc_n", "doc_ids"]
            out = pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(row, kinds, strict=True)), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(keys))], names=names)
            keys, texts, shard, before, held = [], [], shard + 1, before + held, 0
            return out

        for b in batches:
            if b.num_rows:
                part = b.column(3)[0].as_py()
            for i, text in enumerate(b.column(2)):
                raw = encode(text.as_py()) + end
                keys.append(b.column(0).slice(i, 1))
                texts.append(raw)
                held += len(raw) // 4
                if held >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    ordered.mapInArrow(lean(run, "word encoder"), f"{FILE_SCHEMA}, doc_ids array<{kind}>").write.parquet(path)


def read_grammar(files: DataFrame) -> DataFrame:
    """(_id, start, n_tokens, ids) of the shards that write_grammar wrote, decoded document by document.

    start counts the ids of all documents before it: those of earlier parts, of which there
    is one total each, of earlier shards of the part, and of the shard before it.  Null ids and
    repeated rows come back as written; no shard gives an empty table.
    """
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "base")
    placed = files.join(F.broadcast(base), "part").select("base", "first", "first_rule", "seq", "lefts", "rights", "lengths", "doc_start", "doc_n", "doc_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                base, first, rule, seq, left, right, lengths = (b.column(c)[r].as_py() for c in range(7))
                shard = Shard(seq, left, right, lengths, rule)
                start, n = b.column(7)[r].values.to_numpy(), b.column(8)[r].values.to_numpy()
                who = b.column(9)[r].values
                for lo in range(0, len(n), 512):
                    some = [shard.ids(s, k).astype("<u4").tobytes() for s, k in zip(start[lo : lo + 512].tolist(), n[lo : lo + 512].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [who.slice(lo, 512), pa.array(start[lo : lo + 512] + (base + first)), pa.array(n[lo : lo + 512]), pa.array(some, pa.binary()), pa.array([zlib.crc32(x) for x in some], pa.int64())],
                        names=[ID, "start", "n_tokens", "ids", "ids_crc32"],
                    )

    return placed.mapInArrow(lean(run), f"{ID} {kind}, start long, n_tokens long, ids binary, ids_crc32 long")


def grammar_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the grammar files to the shared folder and read them back: (_id, start, n_tokens, ids, ids_crc32).

    Nulls, ties, empty texts and tables, and further columns are as in write_grammar.
    """
    import uuid

    from tidemark.llm import common

    path = f"{common.shared_dir(docs.sparkSession)}/tidemark-grammar-{uuid.uuid4().hex}"
    write_grammar(docs, path, id_col, text_col, tokenizer)
    common._made.append((docs.sparkSession, path))
    return read_grammar(docs.sparkSession.read.parquet(path))
