"""SentencePiece (BPE) encoding by a prefix table, and decoding.

The encoding of every prefix of a text ends in exactly one token, and what is
left of it is the encoding of a shorter prefix. So one pass stores the last
token of each prefix: among the vocabulary entries that end there (found by an
automaton) it is the one that is compatible with the last token before it,
i.e. the pair encodes to itself. The ids are then read backwards.

No entry of the vocabulary has a word mark after another character, so a text
falls apart in front of each run of word marks; characters that occur in no
longer entry (line ends, say) stand alone. Parts are encoded once per worker
and remembered.

Defined results: a null or empty text has no tokens but the end id and decodes
to the empty text; very long unbroken parts take time linear in their length;
every row gives one row, repeated rows too; an empty table gives none.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import slices

MARK = "▁"
# parts of earlier batches remembered per Python worker (the current batch comes on top), and the longest part worth remembering
MEMO_PARTS = 150_000
MEMO_CHARS = 48
# parts encoded side by side: characters with dense transitions, longest entry and part there, slots of the pair cache
DENSE_CHARS = 160
DENSE_LENGTH = 16
DENSE_WIDTH = 24
PAIR_BITS = 20


class PieceTable:
    """Vocabulary of one model with the prefix-table encoder."""

    def __init__(self, model: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(model, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only BPE models with identity normalisation and a leading word mark are handled")
        kinds = {"unknown": 2, "control": 3, "byte": 6}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.is_byte: list[bool] = []
        self.controls: set[int] = set()
        self.unknown = 0
        for i, p in enumerate(spec.pieces):
            self.is_byte.append(p.type == kinds["byte"])
            if p.type == kinds["byte"]:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif p.type == kinds["control"]:
                self.controls.add(i)
                self.bytes_of.append(b"")
            elif p.type == kinds["unknown"]:
                self.unknown = i
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.score[p.piece], self.id_of[p.piece] = p.score, i
                self.bytes_of.append(p.piece.replace(MARK, " ").encode())
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("an entry spans words; texts cannot be cut at word marks")
        self.end_id = next(i for i, p in enumerate(spec.pieces) if p.piece == "</s>")
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        joined = {c for p in self.score if len(p) > 1 for c in p}
        self.lonely = re.compile("([^" + re.escape("".join(sorted(joined))) + "])")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.build_trie()

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first and leftmost among equals; used on pairs of tokens only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[(a, b)] = self.merged(a + b) == [a, b]
        return known

    def whole(self, a: str) -> bool:
        known = self.alone.get(a)
        if known is None:
            known = self.alone[a] = self.merged(a) == [a]
        return known

    def tokens(self, part: str) -> list[str]:
        """Tokens of one part by the prefix table; a character outside the vocabulary is a token of its own.

        The automaton reports matches by their end, so the table fills from left to right.
        """
        n, pairs, alone = len(part), self.pairs, self.alone
        last: list[str | None] = [None] * (n + 1)
        for end, t in self.automaton.iter(part):
            i = end + 1
            if last[i] is None:
                start = i - len(t)
                if start:
                    before = last[start] or part[start - 1]
                    fits = pairs.get((before, t))
                    if fits is None:
                        fits = self.compatible(before, t)
                else:
                    fits = alone.get(t)
                    if fits is None:
                        fits = self.whole(t)
                if fits:
                    last[i] = t
        out, i = [], n
        while i:
            t = last[i] or part[i - 1]
            out.append(t)
            i -= len(t)
        out.reverse()
        return out

    def build_trie(self) -> None:
        """Dense transitions over the characters that most entries use; the rest is left to ``tokens``."""
        use = Counter(c for p in self.score for c in p)
        common = [c for c, _ in use.most_common(DENSE_CHARS)]
        self.char_class = np.full(0x110000, -1, dtype=np.int16)
        self.char_class[0] = 0
        for k, c in enumerate(common):
            self.char_class[ord(c)] = k + 1
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for p, i in self.id_of.items():
            at = 0
            classes = [int(self.char_class[ord(c)]) for c in p]
            if min(classes) < 1 or len(p) > DENSE_LENGTH:
                continue
            for c in classes:
                at = nodes.setdefault((at, c), len(nodes) + 1)
            ends[at] = i
        # row 0 is the root, the last row has no way out
        self.dead = len(nodes) + 1
        self.trie = np.full((self.dead + 1, len(common) + 1), self.dead, dtype=np.int32)
        for (node, c), to in nodes.items():
            self.trie[node, c] = to
        self.node_id = np.full(self.dead + 1, -1, dtype=np.int32)
        for node, i in ends.items():
            self.node_id[node] = i
        self.deepest = max((len(p) for p in self.id_of if len(p) <= DENSE_LENGTH), default=1)
        self.name = {i: p for p, i in self.id_of.items()}
        self.length_of = np.array([len(self.name.get(i, "")) for i in range(len(self.bytes_of))])
        self.piece_bytes = pa.array(self.bytes_of, pa.binary())
        # direct-mapped view of the pair dictionary
        self.slot_key = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.slot_fits = np.zeros(1 << PAIR_BITS, dtype=bool)

    def fits(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Compatibility of id pairs; ``before`` -1 stands for the beginning."""
        key = (before.astype(np.int64) + 1) * len(self.bytes_of) + after
        slot = (key * 0x9E3779B1 >> 7) & ((1 << PAIR_BITS) - 1)
        new = np.flatnonzero(self.slot_key[slot] != key)
        if len(new):
            _, first = np.unique(key[new], return_index=True)
            for j in new[first]:
                b, a = int(before[j]), self.name[int(after[j])]
                self.slot_fits[slot[j]] = self.whole(a) if b < 0 else self.compatible(self.name[b], a)
                self.slot_key[slot[j]] = key[j]
            clash = np.flatnonzero(self.slot_key[slot] != key)
            out = self.slot_fits[slot]
            for j in clash:
                b, a = int(before[j]), self.name[int(after[j])]
                out[j] = self.whole(a) if b < 0 else self.compatible(self.name[b], a)
            return out
        return self.slot_fits[slot]

    def learn(self, parts: list[str]) -> None:
        """Encode many short parts at once, all prefix tables side by side, and remember them."""
        parts = sorted({p for p in parts if 1 < len(p) <= DENSE_WIDTH}, key=len)
        for at in range(0, len(parts), 4096):
            chunk = parts[at:at + 4096]
            width = len(chunk[-1])
            codes = np.array(chunk, dtype=f"U{width}").view("<u4").reshape(len(chunk), width)
            classes = self.char_class[codes]
            known = np.flatnonzero((classes >= 0).all(axis=1))
            if len(known) == 0:
                continue
            classes, n = classes[known], len(known)
            # entry that covers [start, start + length), or -1
            entry = np.full((width, self.deepest, n), -1, dtype=np.int32)
            for start in range(width):
                node = np.zeros(n, dtype=np.int32)
                for length in range(min(self.deepest, width - start)):
                    node = self.trie[node, classes[:, start + length]]
                    entry[start, length] = self.node_id[node]
            last = np.full((width + 1, n), -1, dtype=np.int32)
            for i in range(1, width + 1):
                for length in range(min(self.deepest, i), 0, -1):
                    found = entry[i - length, length - 1]
                    todo = np.flatnonzero((found >= 0) & (last[i] < 0))
                    if len(todo):
                        hit = todo[self.fits(last[i - length][todo] if length < i else np.full(len(todo), -1), found[todo])]
                        last[i, hit] = found[hit]
            # read all tables backwards at once
            at_char = np.array([len(chunk[k]) for k in known])
            rows, columns = np.arange(n), []
            while at_char.any():
                t = np.where(at_char > 0, last[at_char, rows], -1)
                columns.append(t)
                at_char -= np.where(t >= 0, self.length_of[t], 0)
            found = np.stack(columns[::-1], axis=1)
            counts = (found >= 0).sum(axis=1) * 4
            raw, ends = found[found >= 0].astype("<i4").tobytes(), np.cumsum(counts).tolist()
            begin = 0
            for k, end in zip(known.tolist(), ends):
                self.remember(chunk[k], raw[begin:end])
                begin = end

    def remember(self, part: str, ids: bytes) -> bytes:
        if len(part) <= MEMO_CHARS:
            self.memo[part] = ids
        return ids

    def ids(self, part: str) -> list[int]:
        out: list[int] = []
        for t in self.tokens(part):
            i = self.id_of.get(t)
            if i is None:
                out.extend(self.byte_ids[b] for b in t.encode())
            else:
                out.append(i)
        return out

    def part(self, part: str) -> bytes:
        """Ids of a part, as int32 bytes."""
        known = self.memo.get(part)
        if known is None:
            known = self.older.get(part)
            if known is not None:
                self.remember(part, known)
        if known is None:
            cut = [x for x in self.lonely.split(part) if x]
            if len(cut) > 1:
                return b"".join([self.part(x) for x in cut])
            known = self.remember(part, array("i", self.ids(part)).tobytes())
        return known

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of parts, new short ones learnt together."""
        if len(self.memo) >= MEMO_PARTS:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = [p for p in words if p not in memo and p not in older]
        self.learn([x for p in new for x in self.lonely.split(p) if x and x not in memo and x not in older])
        return [self.part(p) for p in words]

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text, end id included. Equal words of a batch are encoded once."""
        plain = pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring_regex(texts, f"^ |  | $|{MARK}")))
        fast, slow = texts.filter(plain), texts.filter(pc.invert(plain)).to_pylist()
        cut = pc.split_pattern(fast, " ")
        words = cut.flatten().dictionary_encode()
        coded = self.encode_words([MARK + w for w in words.dictionary.to_pylist()] + [chr(0)])
        end = np.int32(self.end_id).tobytes()
        coded[-1] = end
        lists = id_lists(coded)
        # the end id is one more word of each text
        sizes = cut.value_lengths().to_numpy(zero_copy_only=False)
        stops = np.cumsum(sizes)
        index = np.insert(words.indices.to_numpy(zero_copy_only=False), stops, len(coded) - 1)
        taken = lists.take(pa.array(index))
        word_ends = taken.offsets.to_numpy()
        offsets = word_ends[np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])]
        done = pa.ListArray.from_arrays(pa.array(offsets.astype("<i4")), taken.flatten())
        rest = id_lists([b"".join([self.part(p) for p in self.marked(t)]) + end for t in slow])
        both = pa.concat_arrays([done, rest])
        order = np.empty(len(texts), dtype=np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        order[mask], order[~mask] = np.arange(len(fast)), len(fast) + np.arange(len(slow))
        return both.take(pa.array(order))

    @staticmethod
    def marked(text: str) -> list[str]:
        """Cuts in front of each run of word marks."""
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", MARK + text.replace(" ", MARK)) if text else []

    def decode_array(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        pieces = self.piece_bytes.take(ids.flatten())
        ends = pieces.buffers()[1]
        at = np.frombuffer(ends, dtype="<i4", count=len(pieces) + 1)[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
        raw = pieces.buffers()[2].to_pybytes() if pieces.buffers()[2] else b""
        return pa.array([self.as_text(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())

    def encode(self, text: str) -> list[int]:
        return self.encode_array(pa.array([text], pa.string()))[0].as_py()

    @staticmethod
    def as_text(raw: bytes) -> str:
        """The leading word mark is no part of the text; a byte that begins no character becomes U+FFFD."""
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, i = [], 0
            while i < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[i:i + n].decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_array(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def id_lists(coded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) // 4 for x in coded]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))


@lru_cache(maxsize=2)
def piece_table(model: str) -> PieceTable:
    return PieceTable(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# texts encoded at once; their ids and decoded texts are what a worker holds besides its batch
ENCODE_ROWS = 500


def encode_decode(docs: DataFrame, model: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded) per row: ids with an end id only, and the text that they decode to.

    Map-only. ``model`` is a file that every executor has (by default the
    installed vocabulary); each worker reads it once.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_table(model or default_model())
        for batch in batches:
            for part in slices(batch, ENCODE_ROWS):
                ids = enc.encode_array(pc.fill_null(part.column(1), ""))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, enc.decode_array(ids)], names=[key, "ids", "decoded"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The op8 contract: counts and digests derived from ids and decoded texts."""
    out = encode_decode(docs, model)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
