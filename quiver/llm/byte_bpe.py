"""BPE encoding and decoding: speculate with greedy longest matches, verify, merge exactly only where that fails.

A sequence of tokens is the byte-pair encoding of its bytes exactly if each token encodes to itself and every
adjacent pair is compatible: no merge crosses the border between the two before the border's own tokens are whole.
So a word's greedy longest-match tokens, proposed for many words at once by walking a trie in step, are checked pair
by pair with array operations that undo both tokens' merges along the border; only words with an incompatible pair
go through the exact merge loop. Results of words are memoised in each worker up to a bound.

Defined results: a null text encodes as an empty one (no ids); a special string inside a text becomes its own id.
"""

from __future__ import annotations

import heapq
import json
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quiver.llm.common import map_batches, sorted_distinct, texts_of

# The word pattern of byte-level BPE with this kind of file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Where this library's and the tokenizers library's classes of characters agree; other texts are split by the latter.
SURE = regex.compile(
    "[\u0000-ԯ؀-ۿऀ-ॿ -⁯₠-₿　-ヿ一-鿿가-힣\U0001f300-\U0001f64f]*+"
)

NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable bytes for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str, memo: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError("added tokens that take in white space aren't handled")
        letter, vocab = byte_letters(), model["vocab"]
        self.path, self.memo, self._splitter = path, memo, None
        self.special = {x["content"]: x["id"] for x in added}
        size = self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letter[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode("utf-8")
        self.byte_id = np.zeros(256, np.int64)
        for i in vocab.values():
            if len(self.bytes_of[i]) == 1:
                self.byte_id[self.bytes_of[i][0]] = i
        # the tree of merges: what each token is made of, and when
        self.left, self.right = np.arange(size), np.arange(size)
        self.made = np.full(size, -1, np.int64)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        keys = np.zeros(len(model["merges"]), np.int64)
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = vocab[a], vocab[b], vocab[a + b]
            self.rank[a, b] = (k, t)
            keys[k] = a * size + b
            if self.made[t] < 0:
                self.left[t], self.right[t], self.made[t] = a, b, k
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], order.astype(np.int64)
        merged = np.flatnonzero(self.made >= 0)
        whole = np.array([len(x) == 1 for x in self.bytes_of])
        whole[list(self.special.values())] = False
        inside = self.compatible(self.left[merged], self.right[merged], within=self.made[merged])
        for t, fine in zip(merged[np.argsort(self.made[merged])], inside[np.argsort(self.made[merged])], strict=True):
            whole[t] = fine and whole[self.left[t]] and whole[self.right[t]]
        self._build_trie(np.flatnonzero(whole))
        self._reset()

    def _reset(self) -> None:
        """Forget the words met, but for the special strings, which are never words by the pattern."""
        self.word: dict[str, int] = {x: k for k, x in enumerate(self.special)}
        self.flat = np.array([*self.special.values()] + [0] * 1024, np.uint32)
        self.used = len(self.special)
        self.start = np.arange(self.used, dtype=np.int64)
        self.count = np.ones(self.used, np.int64)
        self.proposed = self.failed = 0

    # -- verification

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging each pair, NEVER if there is no such merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """Whether the border between tokens a and b lasts until both are whole (and then, or until merge ``within``).

        Merges are undone latest first on the border's two sides. While x and y face each other, a merge of the two
        would come first if it ranks before the merge that took x up (equal ranks go left to right, so on a tie the
        left one wins) and not after the merge that took y up.
        """
        fine = np.ones(len(a), bool)
        todo = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        up_x = np.full(len(a), NEVER)
        up_y = up_x.copy()
        first = within is not None
        while len(todo):
            rank = self.pair(x, y)
            clash = (rank < up_x) & (rank <= up_y) & (rank != NEVER)
            if first:
                clash &= rank != within
                first = False
            fine[todo[clash]] = False
            made_x, made_y = self.made[x], self.made[y]
            go = ~clash & ((made_x >= 0) | (made_y >= 0))
            undo_x = made_x > made_y
            up_x, up_y = np.where(undo_x, made_x, up_x)[go], np.where(undo_x, up_y, made_y)[go]
            x, y = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go]
            todo = todo[go]
        return fine

    # -- speculation

    def _build_trie(self, tokens: np.ndarray) -> None:
        edges: dict[int, int] = {}
        ends = {}
        for t in tokens.tolist():
            node = 0
            for byte in self.bytes_of[t]:
                node = edges.setdefault(node << 8 | byte, len(edges) + 1)
            ends[node] = t
        self.edge = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[e] for e in self.edge.tolist()], np.int64)
        self.first = np.zeros(256, np.int64)
        self.first[self.edge[self.edge < 256]] = self.child[self.edge < 256]
        self.ends = np.full(len(edges) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that starts at each position and its length; ``end``: where the position's word ends."""
        token, length = self.byte_id[data[at]].copy(), np.ones(len(at), np.int64)
        node, live, depth = self.first[data[at]], np.arange(len(at)), 1
        while True:
            more = at[live] + depth < end[live]
            live, node = live[more], node[more]
            if not len(live):
                return token, length
            key = node << 8 | data[at[live] + depth]
            k = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[k] == key
            live, node = live[hit], self.child[k[hit]]
            depth += 1
            found = self.ends[node]
            better = found >= 0
            token[live[better]], length[live[better]] = found[better], depth

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy tokens of all words, one after the other, and how many each word has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        at, live = ends - sizes, np.arange(len(words))
        owners, places, tokens = [], [], []
        for _ in range(40):  # in step while many words are open
            if not len(live):
                break
            token, length = self.longest(data, at[live], ends[live])
            owners.append(live)
            places.append(at[live])
            tokens.append(token)
            at[live] += length
            live = live[at[live] < ends[live]]
        for w in live.tolist():  # the few long ones: all positions at once, then follow the chain
            spots = np.arange(at[w], ends[w])
            token, length = self.longest(data, spots, np.full(len(spots), ends[w]))
            step, chosen, p = length.tolist(), [], 0
            while p < len(step):
                chosen.append(p)
                p += step[p]
            owners.append(np.full(len(chosen), w))
            places.append(spots[chosen])
            tokens.append(token[chosen])
        owner, place, token = np.concatenate(owners), np.concatenate(places), np.concatenate(tokens)
        return token[np.argsort(place, kind="stable")], np.bincount(owner, minlength=len(words))

    def merge(self, word: bytes) -> list[int]:
        """The exact merge loop: always the lowest rank, the leftmost of equals."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.rank.get(p))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0:
                continue
            found = self.rank.get((ids[i], ids[j]))
            if not found or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if r := self.rank.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (r[0], i))
            if before[i] >= 0 and (r := self.rank.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (r[0], before[i]))
        return [x for x in ids if x >= 0]

    def learn(self, new: list[str]) -> None:
        """Encode words that aren't known yet."""
        words = [x.encode("utf-8") for x in new]
        tokens, counts = self.propose(words)
        owner = np.repeat(np.arange(len(words)), counts)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, inverse = np.unique(tokens[same] * self.size + tokens[same + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)[inverse]
        bad = sorted_distinct(owner[same[~fine]])
        self.proposed, self.failed = self.proposed + len(words), self.failed + len(bad)
        if len(bad):
            good = np.ones(len(words), bool)
            good[bad] = False
            exact = [np.array(self.merge(words[w]), np.int64) for w in bad.tolist()]
            tokens, counts = np.concatenate([tokens[good[owner]], *exact]), np.concatenate([counts[good], [*map(len, exact)]])
            new = [*(new[w] for w in np.flatnonzero(good).tolist()), *(new[w] for w in bad.tolist())]
        if self.used + len(tokens) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(tokens), np.uint32)])
        self.flat[self.used : self.used + len(tokens)] = tokens
        starts = self.used + np.cumsum(counts) - counts
        self.used += len(tokens)
        self.word.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
        self.start, self.count = np.concatenate([self.start, starts]), np.concatenate([self.count, counts])

    # -- whole texts

    def words(self, text: str) -> list[str]:
        if not self.special:
            return self._words(text)
        parts = self._special_pattern().split(text)
        if len(parts) == 1:
            return self._words(text)
        return [w for i, x in enumerate(parts) for w in ([x] if i % 2 else self._words(x))]

    def _special_pattern(self) -> regex.Pattern:
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def _words(self, text: str) -> list[str]:
        if SURE.fullmatch(text):
            return regex.findall(WORDS, text)
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (unsigned 32-bit) of each text."""
        split = [self.words(t) if t else [] for t in texts]
        if len(self.word) > self.memo:
            self._reset()
        new = set().union(*split) - self.word.keys()
        if new:
            self.learn(sorted(new))
        index = np.fromiter(map(self.word.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        count = self.count[index]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[index] - (ends - count), count) + np.arange(total)]
        border = np.concatenate([[0], ends])[np.cumsum([len(x) for x in split])]
        return np.split(ids, border[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """This process's codec for a file."""
    return _codecs.get(path) or _codecs.setdefault(path, ByteBpe(path))


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id and ids (array of long)."""
    schema = T.StructType(
        [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.LongType()))]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(path).encode(texts_of(batch))
        flat = np.concatenate(ids).astype(np.int64)
        border = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(border, pa.array(flat))], schema.names)

    return map_batches(documents.select("doc_id", "text"), run, schema)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its ids (little-endian, 32 bits each) and of the decoded text."""
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path)
        ids = bpe.encode(texts_of(batch))
        columns = [
            batch.column("doc_id"),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return map_batches(documents.select("doc_id", "text"), run, schema)
