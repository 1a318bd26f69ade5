"""Best-fit packing of tokenised documents into training sequences.

Documents are tokenised, closed with an end id and cut into pieces of at most
``SIZE`` tokens (only longer documents are cut).  Pieces are packed online by
best fit with a fixed number of open bins: a bit set over the free space finds
the open bin with the least space that still fits, and when all bins are open
and none fits, the fullest one closes first.

Pieces (a few numbers each, no texts or ids) are dealt by hash to packers of
about ``PER_PACKER`` pieces; each packer takes its pieces in hash order, which
mixes sizes and does not depend on arrival, so a rerun after a lost executor
packs alike.  Memory of a packer is its open bins.

Tokenising: the tokenizer never joins across white space, so the ids of a text
are those of its white-space words in turn.  Each worker remembers the ids of
words it has seen (two generations of at most ``REMEMBER_BYTES``, and one batch's
new words) and encodes
the new words of a batch in one go.  Where the bytes of the ids' tokens add up to
those of the words, they show where each word's ids end; else a mark stands between
the words.  Under the tokenizer's usual rules (lower case, runs of letters apart from
punctuation) ASCII capitals are lowered first, a word of lower-case letters skips those
rules, and punctuation behind it has ids of its own.  A group's words are split and numbered
by Arrow, so each distinct one is looked up once.  After a partition a worker keeps at most ``STAY_BYTES``: the younger
generation, or those of its words that both generations held; other work in that worker drops the
encoder (``memory.kept``).

Defined results: a null or empty text is the end id alone; repeated rows are
packed as further documents; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import json
import operator
import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from skein.llm.memory import kept, trimmed

SIZE = 4096
END_ID = 1
OPEN_BINS = 1024
PER_PACKER = 100_000
#: bytes of words and ids in one of the two generations, with ``_ENTRY`` for each
REMEMBER_BYTES, _ENTRY = 48 << 20, 160
#: of these, bytes that stay after a partition
STAY_BYTES = 16 << 20
#: words encoded together
_TOGETHER = 512
#: private-use character between words that are encoded together
_MARK = "\ue000"
#: words whose ids are put together at once
_AT_ONCE = 1 << 18
#: the rules under which ``_PLAIN`` words may be encoded apart from them
_RULES = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
_RUNS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: composed lower-case Latin letters, and ASCII punctuation but the apostrophe behind them
_PLAIN = rb"((?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++)([!-&(-/:-@\[-`{-~]*)"
#: the two parts of each line, empty for other lines
_PARTS = re.compile(_PLAIN + rb"\n|[^\n]*\n")


class WordEncoder:
    """Ids of texts by the ids of their white-space words, as packed bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self._without_rules()
        self.mark = np.array(self._ids(_MARK), np.uint32)
        self.sizes = self._token_sizes()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0                   # bytes of the younger generation

    def _without_rules(self):
        """The tokenizer for words that its rules leave as they are, if it has just those rules."""
        spec = json.loads(self.tokenizer.to_str())
        rules = spec["normalizer"] or {}
        rules = rules.get("normalizers", [rules])
        self.special = [t["content"].lower().encode() for t in spec["added_tokens"]]
        if {"type": "Lowercase"} not in rules or any(r not in _RULES for r in rules) or spec["pre_tokenizer"] != _RUNS:
            return None
        spec["normalizer"] = None
        spec["pre_tokenizer"] = _RUNS | {"pretokenizers": [{"type": "WhitespaceSplit"}, _RUNS["pretokenizers"][1]]}
        return type(self.tokenizer).from_str(json.dumps(spec))

    def _lowered(self, text: bytes) -> bytes:
        """The text with ASCII capitals lowered, where the tokenizer does so: not before a
        combining mark (composed first) nor where that would make a special token."""
        if self.plain is None or b"\xcc" in text or b"\xcd" in text:
            return text
        low = text.lower()
        return text if any(t in low for t in self.special) else low

    def _ids(self, text: str, tokenizer=None) -> list[int]:
        return (tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _token_sizes(self) -> np.ndarray:
        """Bytes that each id stands for, if tokens are byte-level ones."""
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        sizes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, number in vocab.items():
            sizes[number] = len(token.removesuffix(suffix))
        return sizes

    def forget(self) -> None:
        """Drop the older generation, and all that is beyond ``STAY_BYTES`` of the younger."""
        if self.held > STAY_BYTES:
            both = self.young.keys() & self.old.keys()
            young, self.young, self.held = self.young, {}, 0
            for w in both:
                if self.held > STAY_BYTES:
                    break
                self._keep(w, young[w])
        self.old = {}

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words; those that are not remembered are encoded, many at once."""
        if self.held > REMEMBER_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        known = list(map(self.young.get, words))
        missing = [i for i, ids in enumerate(known) if ids is None]
        self._learn(self._renewed([w for i in missing if (w := words[i])]))
        for i in missing:
            known[i] = self.young[w] if (w := words[i]) else b""
        return known

    def _learn(self, new: list[bytes]) -> None:
        """Encode distinct words that neither generation holds."""
        behind = []                     # words with punctuation behind letters
        if self.plain is not None and new:
            parts = _PARTS.findall(b"\n".join(new) + b"\n")     # words hold no white space
            behind = [(w, core, end) for w, (core, end) in zip(new, parts) if end]
            letters = [w for w, (core, end) in zip(new, parts) if core and not end]
            new = [w for w, (core, _) in zip(new, parts) if not core]
            for some, more in ((new, {end for _, _, end in behind}), (letters, {core for _, core, _ in behind})):
                some += self._renewed([w for w in more.difference(some) if w not in self.young])
            self._learn_all(letters, self.plain)
        # characters beyond ASCII may change their length: such words go apart
        self._learn_all([w for w in new if w.isascii()])
        self._learn_all([w for w in new if not w.isascii()])
        if behind:
            words, cores, ends = zip(*behind)
            get = self.young.__getitem__
            self._keep_all(words, list(map(operator.concat, map(get, cores), map(get, ends))))

    def _renewed(self, words: list[bytes]) -> list[bytes]:
        """Those of ``words`` that the older generation does not hold; its own become young."""
        if self.old:
            ids = list(map(self.old.get, words))
            self._keep_all([w for w, i in zip(words, ids) if i is not None], [i for i in ids if i is not None])
            words = [w for w, i in zip(words, ids) if i is None]
        return words

    def _learn_all(self, words: list[bytes], tokenizer=None) -> None:
        for at in range(0, len(words), _TOGETHER):
            part = words[at:at + _TOGETHER]
            if not self._learn_by_size(part, tokenizer):
                self._learn_by_mark(part)

    def _learn_by_size(self, part: list[bytes], tokenizer=None) -> bool:
        """Encode words divided by spaces, if each word's last byte ends a token."""
        ids = np.array(self._ids(b" ".join(part).decode(), tokenizer), "<u4")
        ends = np.cumsum(self.sizes[ids])
        lengths = list(map(len, part))
        wanted = np.cumsum(lengths)
        if not len(ids) or ends[-1] != wanted[-1]:
            return False
        cuts = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[cuts], wanted) or not self.sizes[ids].all():
            return False
        cuts = (4 * cuts + 4).tolist()
        raw = ids.tobytes()
        self._keep_all(part, list(map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
        return True

    def _learn_by_mark(self, part: list[bytes]) -> None:
        """Encode words with the mark's ids between them; words with the mark in
        them go alone."""
        mark = _MARK.encode()
        alone = [w for w in part if mark in w]
        part = [w for w in part if mark not in w]
        ids = np.array(self._ids(f" {_MARK} ".join(map(bytes.decode, part))), "<u4")
        cuts = self._marks(ids)
        if len(cuts) != len(part) - 1:      # a word whose ids look like the mark's
            alone += part
        else:
            raw, size = ids.tobytes(), 4 * len(self.mark)
            start = 0
            for w, cut in zip(part, [*(4 * cuts).tolist(), len(raw)]):
                self._keep(w, raw[start:cut])
                start = cut + size
        for w in alone:
            self._keep(w, np.array(self._ids(w.decode()), "<u4").tobytes())

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.young[word] = ids
        self.held += len(word) + len(ids) + _ENTRY

    def _keep_all(self, words: Sequence[bytes], ids: list[bytes]) -> None:
        self.young.update(zip(words, ids))
        self.held += sum(map(len, words)) + sum(map(len, ids)) + _ENTRY * len(ids)

    def _marks(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - len(self.mark) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        hit = np.ones(n, bool)
        for k, m in enumerate(self.mark):
            hit &= ids[k:k + n] == m
        return np.flatnonzero(hit)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        lines = pa.array(map(self._lowered, texts), pa.binary()).view(pa.string())
        split = pc.ascii_split_whitespace(lines)
        named = split.flatten().dictionary_encode()
        words = named.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        known = self.ids_of(words)
        flat, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, codes = np.cumsum(sizes) - sizes, named.indices.to_numpy()
        ends = np.append(0, np.cumsum(sizes[codes]))
        out = np.empty(ends[-1], "<u4")
        for at in range(0, len(codes), _AT_ONCE):
            some = codes[at:at + _AT_ONCE]
            first = ends[at:at + len(some)]
            last = ends[at + len(some)]
            places = np.repeat(starts[some] - first, sizes[some]) + np.arange(first[0], last)
            out[first[0]:last] = flat[places]
        bounds = ends[split.offsets.to_numpy()].tolist()
        for start, end in zip(bounds, bounds[1:]):
            yield out[start:end].tobytes()


_ENCODERS: dict[str, WordEncoder] = kept("packing")


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _groups(texts: list, limit: int = 1 << 21) -> Iterator[list[bytes]]:
    """Texts in runs of about ``limit`` bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t or b"")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
           size: int = SIZE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` and the ids of each piece
    (little-endian unsigned 32-bit) unless ``with_ids`` is false."""
    schema = StructType([docs.schema[id_col], StructField("piece", IntegerType()),
                         StructField("start", LongType()), StructField("length", LongType()),
                         StructField("ids_crc32", LongType())]
                        + [StructField("ids", BinaryType())] * with_ids)
    close, step = np.array([end_id], "<u4").tobytes(), 4 * size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            rows, numbers, starts, lengths, sums, kept, row = [], [], [], [], [], [], 0
            for group in _groups(batch.column(1).to_pylist()):
                for ids in words.encode(group):
                    ids += close
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at:at + step]
                        rows.append(row)
                        numbers.append(k)
                        starts.append(at // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part)
                    row += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()),
                 pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(sums, pa.int64())] + [pa.array(kept, pa.binary())] * with_ids, schema.names)
        words.forget()
    return (docs.select(F.col(id_col), F.col(text).cast("string").cast("binary").alias("\x01t"))
            .mapInArrow(trimmed(cut, "packing"), schema))


class Bins:
    """Open bins by free space: one bit per free space that some bin has."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most = size, most_open
        self.spaces = 0                             # the bit set
        self.at: dict[int, list[int]] = {}          # free space -> open bins
        self.open, self.made = 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """Place one piece: ``(bin, offset)``."""
        fits = self.spaces >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:              # the fullest closes
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            free, number = self.size, self.made
            self.made += 1
        left = free - length
        if left:                                    # a full bin closes at once
            self.at.setdefault(left, []).append(number)
            self.spaces |= 1 << left
            self.open += 1
        return number, self.size - free

    def _take(self, free: int) -> int:
        bins = self.at[free]
        number = bins.pop()
        self.open -= 1
        if not bins:
            del self.at[free]
            self.spaces &= ~(1 << free)
        return number


def pack(cut: DataFrame, size: int = SIZE, most_open: int = OPEN_BINS,
         per_packer: int = PER_PACKER) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.  ``cut`` should be stored:
    it is counted first."""
    packers = max(1, -(-cut.count() // per_packer))
    names = [f.name for f in cut.schema]
    order = F.xxhash64(*[c for c in names if c != "ids"])
    dealt = (cut.withColumn("\x01h", order)
             .repartition(packers, "\x01h").sortWithinPartitions("\x01h", *names[:4])
             .drop("\x01h").withColumn("\x01p", F.spark_partition_id()))
    schema = StructType([*cut.schema, StructField("sequence_id", LongType()),
                         StructField("offset", LongType())])
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(size, most_open)
        for batch in batches:
            if not batch.num_rows:
                continue
            base = batch.column(len(names))[0].as_py() << 40
            put = [bins.put(n) for n in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array([base + b for b, _ in put], pa.int64()),
                 pa.array([o for _, o in put], pa.int64())], schema.names)
    return dealt.mapInArrow(trimmed(place), schema)
