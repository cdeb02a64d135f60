"""BPE encoding by speculation, and decoding.

A sequence of tokens is the byte-pair encoding of its text exactly when every token encodes to itself and no two neighbours would have merged across
their border. So words are encoded in three steps, the first two for all new words of a batch at once:

* Speculate: at every position the longest token that starts there, by walking all positions down a trie of the vocabulary together;
  a word's proposal follows those matches from its start.
* Verify: undo the merges of two neighbours, latest first, along their border. They are compatible unless at some moment the two parts that
  touched had a merge of their own that was due before either part was merged away. Of equal ranks the left-most merge comes first.
* Only words with an incompatible pair are merged step by step.

This needs a merge list in which a part is always made before it is merged further, and one merge a token; files of any other kind, and texts that spell
their special tokens in ways other than plainly, are left to the tokenizer whole. Words are remembered, in bounded memory.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, texts_of, with_columns
from .packing import ByteSpelling, by_words

#: Distinct words, and word parts, that a worker remembers, and the bytes of each kind.
REMEMBERED, REMEMBERED_BYTES = 300_000, 80 << 20
#: Bytes of a remembered word beside its strings, about.
OVERHEAD = 250
#: Symbols up to which words are merged together.
SHORT = 64
#: Symbols of new words that are matched at once, unless one word has more.
SYMBOLS_AT_ONCE = 1 << 18
NEVER = np.iinfo(np.int64).max


class Merges:
    """Merge ranks and splits of a BPE model: the tables that both checking and merging read.

    vocabulary: token to id; merges: pairs of tokens, first merged first; suffix: what marks a word's last symbol.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.size = max(vocabulary.values()) + 1
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.proper = True
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocabulary[a], vocabulary[b], vocabulary[(a.removesuffix(suffix) if suffix else a) + b]
            self.proper &= bool(self.rank[made] < 0 and self.rank[x] < rank and self.rank[y] < rank and made not in (x, y))
            self.rank[made], self.left[made], self.right[made] = rank, x, y
        merged = np.flatnonzero(self.rank >= 0)
        key = self.left[merged] * self.size + self.right[merged]
        order = np.argsort(key)
        self.keys, self.made = key[order], merged[order]
        self.made_by = merged[np.argsort(self.rank[merged])]
        self.lookup = dict(zip(self.keys.tolist(), self.made.tolist()))
        self._symbols(self.made_by)

    def _symbols(self, merged: np.ndarray) -> None:
        """Spell tokens in symbols, and keep those that their own merges really make: no earlier merge comes between."""
        fits = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        self.spelled: dict[int, tuple[int, ...]] = {}
        for token, ok in zip(merged.tolist(), fits.tolist()):
            x, y = int(self.left[token]), int(self.right[token])
            spelled = [self.spelled.get(z, (z,) if self.rank[z] < 0 else None) for z in (x, y)]
            if ok and None not in spelled:
                self.spelled[token] = spelled[0] + spelled[1]

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a[i] with b[i], NEVER where there is none."""
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[self.made[at]], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a[i] and b[i], side by side, stay two tokens, or would up to the merge of rank below[i]."""
        out = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        due = np.full(len(a), NEVER) if below is None else below.astype(np.int64)
        while len(at):
            clash = self.merge_of(x, y) < due
            out[at[clash]] = False
            go = ~clash & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y = at[go], x[go], y[go]
            rx, ry = self.rank[x], self.rank[y]
            by_left = rx > ry
            # A merge across the border lies left of the one that made y and right of the one that made x: of equal ranks it beats y's alone.
            due = np.where(by_left, rx, ry + 1)
            x, y = np.where(by_left, self.right[x], x), np.where(by_left, y, self.left[y])
        return out

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merging: always the pair of least rank, the left-most of equal ones."""
        token, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        lookup, size, rank = self.lookup, self.size, self.rank
        queue = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (made := lookup.get(token[i] * size + token[after[i]])) is not None:
                heapq.heappush(queue, (int(rank[made]), i, token[i], token[after[i]], made))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, x, y, made = heapq.heappop(queue)
            j = after[i]
            if token[i] != x or j >= n or token[j] != y:
                continue
            token[i], token[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [t for t in token if t >= 0]

    def merged_together(self, token: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of exact merging of many short words, word i of size[i] symbols: each round makes one merge in every word that has one left."""
        word, rank = np.repeat(np.arange(len(size)), size), np.full(len(token), NEVER)
        beside = np.flatnonzero(word[1:] == word[:-1])
        rank[beside] = self.merge_of(token[beside], token[beside + 1])
        ended = []
        while len(token):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.r_[head, len(word)]))
            over = least == NEVER
            if over.any():
                ended.append(np.stack([word[over], token[over]]))
                word, token, rank, least = word[~over], token[~over], rank[~over], least[~over]
            at = np.flatnonzero(rank == least)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]] if len(at) else at
            token[at] = self.made_by[least[at]]
            stays = np.ones(len(token), bool)
            stays[at + 1] = False
            word, token, rank = word[stays], token[stays], rank[stays]
            at -= np.arange(len(at))
            rank[at] = NEVER
            for x in (at, at - 1):
                x = x[(x >= 0) & (x + 1 < len(word))]
                x = x[word[x] == word[x + 1]]
                rank[x] = self.merge_of(token[x], token[x + 1])
        word, token = np.concatenate(ended, axis=1)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]


class Trie:
    """The vocabulary's spellings; walked for many positions at once."""

    def __init__(self, spelled: dict[tuple[int, ...], int], symbols: int):
        self.width, edges, token = symbols, {}, [-1]
        for spelling, ident in spelled.items():
            node = 0
            for s in spelling:
                key = node * symbols + s
                node = edges.get(key)
                if node is None:
                    node = edges[key] = len(token)
                    token.append(-1)
            token[node] = ident
        order = sorted(edges)
        self.keys, self.next, self.token = np.array(order, np.int64), np.array([edges[k] for k in order], np.int64), np.array(token, np.int64)

    def longest(self, symbols: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, length) of the longest match at each position, of at most room[i] symbols; every single symbol is a token."""
        token, length = np.full(len(symbols), -1, np.int64), np.zeros(len(symbols), np.int64)
        at, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(at):
            key = node * self.width + symbols[at + depth]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            at, node, depth = at[hit], self.next[found[hit]], depth + 1
            ends = self.token[node] >= 0
            token[at[ends]], length[at[ends]] = self.token[node[ends]], depth
            more = room[at] > depth
            at, node = at[more], node[more]
        return token, length


class Encoder:
    """Encodes whole texts to (number of ids, ids in decimal joined by spaces, decoded text)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        parsed = json.loads(self.full.to_str())
        model, added = parsed["model"], parsed["added_tokens"]
        self.name = {i: t for t, i in self.full.get_vocab(with_added_tokens=True).items()}
        self.joins = parsed["decoder"] is None
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        self.speculates = by_words(parsed) and plain and self.joins
        if self.speculates:
            vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
            self.rules = Merges(vocabulary, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], suffix)
            letters = ByteSpelling.letters
            self.speculates = self.rules.proper and all(x + end in vocabulary for x in letters for end in ("", suffix))
        if self.speculates:
            # Symbols are numbered by their tokens' ids; a symbol that ends a word is another one.
            self.inner, self.last = (np.zeros(max(map(ord, letters)) + 1, np.int64) for _ in range(2))
            for x in letters:
                self.inner[ord(x)], self.last[ord(x)] = vocabulary[x], vocabulary[x + suffix]
            base = {(vocabulary[x + end],): vocabulary[x + end] for x in letters for end in ("", suffix)}
            self.trie = Trie(base | {s: t for t, s in self.rules.spelled.items()}, self.rules.size)
            self.parts = regex.compile(parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
            self.special = {t["content"]: t["id"] for t in added}
            self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if added else lambda x: [x]
            self.simple = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*+").fullmatch
        self.spelling = ByteSpelling()
        # Of words as they stand, and of parts in byte letters: the ids in decimal and the decoded text.
        self.ids, self.texts = {}, {}
        self.part_ids, self.part_texts = {}, {}
        self.bytes = self.parts_bytes = 0
        self.speculated = self.exact = 0

    def spell(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part, given in byte letters; parts are not empty."""
        out: list[list[int]] = []
        lo = 0
        while lo < len(parts):
            hi, held = lo, 0
            while hi < len(parts) and (hi == lo or held + len(parts[hi]) <= SYMBOLS_AT_ONCE):
                held += len(parts[hi])
                hi += 1
            out += self._spell(parts[lo:hi])
            lo = hi
        return out

    def _spell(self, parts: list[str]) -> list[list[int]]:
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        end = np.cumsum(size)
        letters = np.frombuffer("".join(parts).encode("utf-16-le"), np.uint16)
        symbols = self.inner[letters]
        symbols[end - 1] = self.last[letters[end - 1]]
        room = np.repeat(end, size) - np.arange(len(symbols))
        token, length = self.trie.longest(symbols, room)
        # All words follow their matches together, a token a step.
        word, at = np.arange(len(parts)), end - size
        words, steps, tokens, n = [], [], [], 0
        while len(word):
            words.append(word)
            tokens.append(token[at])
            steps.append(np.full(len(word), n))
            at = at + length[at]
            going = at < end[word]
            word, at, n = word[going], at[going], n + 1
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        order = np.lexsort((np.concatenate(steps), words))
        words, tokens = words[order], tokens[order]
        beside = np.flatnonzero(words[1:] == words[:-1])
        pair, which = np.unique(tokens[beside] * self.rules.size + tokens[beside + 1], return_inverse=True)
        fits = self.rules.compatible(pair // self.rules.size, pair % self.rules.size)[which]
        wrong = np.zeros(len(parts), bool)
        wrong[words[beside[~fits]]] = True
        short = np.flatnonzero(wrong & (size <= SHORT))
        if len(short):
            taken = np.zeros(len(parts), bool)
            taken[short] = True
            words, tokens = words[~taken[words]], tokens[~taken[words]]
            again, made = self.rules.merged_together(symbols[np.repeat(taken, size)], size[short])
            words, tokens = np.r_[words, short[again]], np.r_[tokens, made]
            order = np.argsort(words, kind="stable")
            words, tokens = words[order], tokens[order]
        cut, flat = np.searchsorted(words, np.arange(len(parts) + 1)).tolist(), tokens.tolist()
        ids = [flat[a:b] for a, b in zip(cut, cut[1:])]
        for i in np.flatnonzero(wrong & (size > SHORT)).tolist():
            ids[i] = self.rules.merged(symbols[end[i] - size[i] : end[i]].tolist())
        self.speculated += len(parts)
        self.exact += int(wrong.sum())
        return ids

    def _parts(self, wanted: list[list[str]]) -> list[tuple[str, str]]:
        """(ids in decimal, decoded text) of each list of parts in byte letters."""
        if len(self.part_ids) > REMEMBERED or self.parts_bytes > REMEMBERED_BYTES:
            self.part_ids.clear()
            self.part_texts.clear()
            self.parts_bytes = 0
        ids, texts, name = self.part_ids, self.part_texts, self.name
        new = list({p for w in wanted for p in w}.difference(ids))
        for p, got in zip(new, self.spell(new)):
            ids[p], texts[p] = " ".join(map(str, got)), " ".join([name[i] for i in got])
            self.parts_bytes += len(p) + len(ids[p]) + len(texts[p]) + OVERHEAD
        return [(ids[w[0]], texts[w[0]]) if len(w) == 1 else (" ".join([ids[p] for p in w]), " ".join([texts[p] for p in w])) for w in wanted]

    def whole(self, text: str) -> tuple[int, str, str]:
        """By the tokenizer alone, for files that this class can't speculate on."""
        ids = self.full.encode(text, add_special_tokens=False).ids
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included."""
        return " ".join([self.name[i] for i in ids]) if self.joins else self.full.decode(ids, skip_special_tokens=False)

    def composed(self, text: str) -> tuple[str, str]:
        """(ids, decoded) of any text: cut at special tokens, normalised and cut into parts as the file says."""
        got = []
        for piece in self.cut(text):
            if piece in self.special:
                got.append((str(self.special[piece]), piece))
            elif piece:
                parts = [p for p, _ in self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(piece)) if p]
                got += self._parts([parts]) if parts else []
        return " ".join([g[0] for g in got]), " ".join([g[1] for g in got])

    def _learn(self, words: list[str]) -> None:
        """Remember plain words: each has at least one part, for only white space belongs to none."""
        spelling, parts = self.spelling, self.parts
        for w, (ids, text) in zip(words, self._parts([[p.translate(spelling) for p in parts(w.lower())] for w in words])):
            self.ids[w], self.texts[w] = ids, text
            self.bytes += len(w) + len(ids) + len(text) + OVERHEAD

    def __call__(self, texts: list[str]) -> list[tuple[int, str, str]]:
        texts = [x if x.isascii() else x.encode("utf-8", "replace").decode() for x in texts]
        if not self.speculates:
            return [self.whole(x) for x in texts]
        if len(self.ids) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.ids.clear()
            self.texts.clear()
            self.bytes = 0
        words = [x.split() if self.simple(x) and not any(s in x for s in self.special) else None for x in texts]
        self._learn(list({w for ws in words if ws for w in ws}.difference(self.ids)))
        out = []
        for x, ws in zip(texts, words):
            if ws is None:
                ids, text = self.composed(x)
            else:
                ids, text = " ".join(map(self.ids.__getitem__, ws)), " ".join(map(self.texts.__getitem__, ws))
            out.append((ids.count(" ") + 1 if ids else 0, ids, text))
        return out


def encoder(path: str) -> Encoder:
    return kept(("bpe", path), lambda: Encoder(path))


def _mapped(docs: DataFrame, path: str, text_col: str, keep: list[str] | None, fields: str, column: dict[str, Callable[[tuple[int, str, str]], object]]) -> DataFrame:
    types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def add(part: pa.RecordBatch) -> dict[str, pa.Array]:
        got = encoder(path)(texts_of(part, text_col))
        return {name: pa.array([make(g) for g in got], types.get(name, pa.string())) for name, make in column.items()}

    keep = docs.columns if keep is None else keep
    return with_columns(docs.select(*dict.fromkeys([*keep, text_col])), add, fields, keep)


def encoded(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns in keep, all by default) with `ids array<int>` and `decoded string`.

    A null text is an empty one and has no ids; an id or any other column may be null. Rows pass through one by one, repeats included; an input column of a new one's name is replaced.
    A lone surrogate counts as a question mark. The path must be readable on every worker.
    """
    return _mapped(docs, path, text_col, keep, "ids array<int>, decoded string", {"ids": lambda g: [int(x) for x in g[1].split()], "decoded": lambda g: g[2]})


def encoding_digests(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As encoded(), with n_tokens long and lower-case hex SHA-256 of the ids in decimal, joined by a space, and of the decoded text in UTF-8."""
    digest = lambda at: lambda g: hashlib.sha256(g[at].encode()).hexdigest()
    return _mapped(docs, path, text_col, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", {"n_tokens": lambda g: g[0], "ids_sha256": digest(1), "decoded_sha256": digest(2)})


def decoded(rows: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """rows (the columns in keep, all by default) with `decoded string` of the ids, special tokens included; null or no ids are an empty text. An id that isn't in the vocabulary raises KeyError."""

    def add(part: pa.RecordBatch) -> dict[str, pa.Array]:
        decode = encoder(path).decode
        return {"decoded": pa.array([decode(x or []) for x in part.column(ids_col).to_pylist()], pa.string())}

    keep = rows.columns if keep is None else keep
    return with_columns(rows.select(*dict.fromkeys([*keep, ids_col])), add, "decoded string", keep)


def op12_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
