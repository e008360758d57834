"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

The tokenizer file gives vocabulary and merge list. Two adjacent tokens are possible neighbours only if merging their joined
symbols gives back just these two; the tokenization of a word is the one chain whose neighbours are all possible, so each
prefix of a word has its own last token, found from the prefixes before it. From the merge list ``Merges`` computes the
longest token in symbols, ``lookahead``: whatever follows, the next token begins at one of the last ``lookahead`` prefixes.
The transducer reads symbols one by one, keeps the chains of these prefixes only, and emits a token once all of them share
it, so memory is constant however long a word is. Every word goes through it; results of short words are remembered (bounded).
New words of many texts are read side by side (``SideBySide``): the same machine, one symbol of all words at a time, over arrays.

Ids leave in batches of ``FLUSH``: each batch is decoded by the state machine ``Decoder`` (what it holds between batches is
the bytes of an unfinished character, or whether a token came before), and both digests are fed as it goes.

Defined results: null and empty texts have no tokens and decode to an empty text; texts are encoded whole; repeated rows
give equal results; a null doc_id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import SPACE, table

#: Words and pairs of tokens, and prefixes, remembered by each worker; then it starts anew.
REMEMBERED, PREFIXES = 120_000, 120_000
#: Ids held before they are decoded and hashed.
FLUSH = 4096
#: Characters of texts that wait until their new words are read, and the least number of words that are read side by side.
HELD, FEW = 1 << 20, 100
#: Two to this power are the pairs of tokens that are remembered where words are read side by side.
PAIR_BITS = 20
EMPTY = hashlib.sha256().hexdigest()
#: Characters read at once, up to the next white space.
STRETCH, BLANK = 1 << 16, re.compile(SPACE)
#: Symbols of prefixes that are remembered; what joins symbols or tokens to keys.
SHORT, SEAM = 10, "\n"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class Merges:
    """A merge list over symbols, and what it implies for streaming."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.end, self.vocab = end, vocab
        self.rank: dict[tuple[str, str], int] = {}
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            self.rank.setdefault((a, b), r)
        self.lookahead = max([1, *(self.symbols(a) + self.symbols(b) for a, b in self.rank)])
        made = {a + b for a, b in self.rank}
        #: Ends of tokens: what no token ends with can't be the beginning of a longer one read backwards.
        self.ends = {t[k:] for t in made for k in range(len(t))}
        self.made = made
        #: The pair that makes each token; an empty one where several do.
        self.parts: dict[str, tuple] = {}
        for pair in self.rank:
            self.parts[pair[0] + pair[1]] = () if pair[0] + pair[1] in self.parts else pair
        self._spines: dict[tuple[str, int], list | None] = {}
        self._pairs: dict[str, bool] = {}
        self.root = (None, None)
        self._nodes: dict[str, tuple] = {}
        self._whole: dict[str, bool] = {}

    def symbols(self, token: str) -> int:
        return len(token) - len(self.end) if self.end and token.endswith(self.end) else len(token)

    def split(self, token: str) -> list[str]:
        """A token's symbols; the word end belongs to the last one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """All merges applied, lowest rank first, leftmost first."""
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def whole(self, token: str) -> bool:
        """Whether a token can be made, and merging its symbols gives it."""
        known = self._whole.get(token)
        if known is None:
            if len(self._whole) > REMEMBERED:
                self._whole.clear()
            known = self._whole[token] = token in self.made and len(self.merged(self.split(token))) == 1
        return known

    def spine(self, token: str, side: int) -> list[tuple[str, float]] | None:
        """The pieces of a token at its right (side 1) or left (0) border, from the symbol up, each with the rank of the merge that ends it; None if its making isn't plain."""
        known = self._spines.get((token, side), False)
        if known is False:
            out, piece, rank = [], token, float("inf")
            while piece is not None:
                out.append((piece, rank))
                pair = self.parts.get(piece)
                if pair is None:
                    known = out[::-1] if self.symbols(piece) == 1 else None
                    break
                if pair == () or self.rank[pair] > rank:
                    known = None
                    break
                rank, piece = self.rank[pair], pair[side]
            self._spines[token, side] = known
        return known

    def neighbours(self, a: str, b: str) -> bool:
        """Whether no merge across the border of two tokens comes before those that make them."""
        known = self._pairs.get(a + SEAM + b)
        if known is None:
            if len(self._pairs) > REMEMBERED:
                self._pairs.clear()
            known = self._pairs[a + SEAM + b] = self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        left, right = self.spine(a, 1), self.spine(b, 0)
        if left is None or right is None:
            return self.merged(self.split(a) + self.split(b)) == [a, b]
        i = j = 0
        while True:
            (x, ends_x), (y, ends_y) = left[i], right[j]
            r = self.rank.get((x, y))
            if r is not None and r < ends_x and r <= ends_y:  # of equal merges the leftmost comes first
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1

    def stream(self, symbols: Iterable[str], prefix: str = "") -> Iterator[str]:
        """Tokens of one word, each as soon as no later symbol can change it (looked at once in ``lookahead`` symbols).

        A node is a prefix: (token that ends there, node before it). ``nodes`` has those of the last prefixes, at least ``lookahead``.
        ``prefix`` is a remembered one, which the word begins with and ``symbols`` goes on from.
        """
        nodes, recent, emitted, most = *self.begun(prefix), self.root, self.lookahead
        symbols = iter(symbols)
        while some := list(islice(symbols, most)):
            self.read(some, nodes, recent)
            if len(nodes) > 2 * most:
                del nodes[: -most - 1], recent[:-most]
                live = [n for n in nodes if n is not None]
                chains = [self.chain(n, emitted) for n in live]
                shared = 0
                while all(len(c) > shared for c in chains) and len({id(c[shared]) for c in chains}) == 1:
                    yield chains[0][shared][0]
                    emitted = chains[0][shared]
                    shared += 1
        for n in self.chain(nodes[-1], emitted):
            yield n[0]

    def begun(self, prefix: str) -> tuple[list, list[str]]:
        """Nodes and symbols after a remembered prefix."""
        return list(self._nodes[prefix]) if prefix else [self.root], list(prefix)

    def read(self, symbols: list[str], nodes: list, recent: list[str]) -> None:
        """Append the nodes of further symbols.

        Those of a word's prefixes of at most SHORT symbols are remembered (bounded), as they are the same for all words that share them.
        """
        ends, whole, pairs, known_nodes = self.ends, self._whole, self._pairs, self._nodes
        short = SHORT if nodes[0] is self.root else 0
        for s in symbols:
            recent.append(s)
            node, token = None, ""
            for size in range(1, min(len(recent), len(nodes)) + 1):
                token = recent[-size] + token
                if size > 1 and token not in ends:
                    break
                before = nodes[-size]
                if before is None:
                    continue
                if size > 1:
                    good = whole.get(token)
                    if good is None:
                        good = self.whole(token)
                    if not good:
                        continue
                last = before[0]
                if last is not None:
                    good = pairs.get(last + SEAM + token)
                    if good is None:
                        good = self.neighbours(last, token)
                    if not good:
                        continue
                node = (token, before)
                break
            nodes.append(node)
            if len(recent) <= short and len(s) == 1:
                known_nodes["".join(recent)] = tuple(nodes)

    @staticmethod
    def chain(node, emitted) -> list:
        """Nodes after ``emitted`` up to ``node``."""
        out = []
        while node is not emitted and node is not None and node[1] is not None:
            out.append(node)
            node = node[1]
        return out[::-1]

    def tokens(self, body: str) -> list[str]:
        """Tokens of a word given as its symbols without the end mark."""
        known = self._nodes
        if len(known) > PREFIXES:
            known.clear()
        n = min(SHORT, len(body) - 1)
        while n and body[:n] not in known:
            n -= 1
        rest = list(body[n:])
        rest[-1] += self.end
        if len(body) > self.lookahead:
            return list(self.stream(rest, body[:n]))
        nodes, recent = self.begun(body[:n])
        self.read(rest, nodes, recent)
        return [n[0] for n in self.chain(nodes[-1], self.root)]


class SideBySide:
    """The machine of ``Merges`` over many short words at once: their n-th symbols are read together, as arrays.

    A trie holds the tokens read backwards, so a token is its node; those of one symbol come first, plain and as a word's last.
    """

    def __init__(self, merges: Merges, symbols: list[str]):
        self.merges = merges
        self.last = len(symbols) if merges.end else 0
        self.names: list[str | None] = [*symbols, *(c + merges.end for c in symbols if merges.end)]
        number = {c: i for i, c in enumerate(self.names)}
        whole, longer, width = [1] * len(self.names), {}, len(symbols)
        for token in merges.made:
            path = [number.get(s) for s in reversed(merges.split(token))]
            if None in path:  # not of bytes, so no word holds it
                continue
            at = path[0]
            for s in path[1:]:
                if (node := longer.get(at * width + s)) is None:
                    node = longer[at * width + s] = len(self.names)
                    self.names.append(None)
                    whole.append(0)
                at = node
            self.names[at], whole[at] = token, -1
        #: 1: merging its symbols gives the token; 0: it doesn't, or there is none; -1: not asked yet.
        self.whole = np.array(whole, "int8")
        self.ids = np.array([-1 if t is None else merges.vocab.get(t, -1) for t in self.names], "int32")
        keys, nodes = np.array(list(longer), "int64"), np.array(list(longer.values()), "int32")
        parents, read = keys // width, keys % width
        # a node with one longer one keeps it by itself, others have a row
        n = np.bincount(parents, minlength=len(self.names))
        self.one, self.one_node, self.row = np.full(len(n), -1, "int16"), np.full(len(n), -1, "int32"), np.zeros(len(n), "int32")
        alone = n[parents] == 1
        self.one[parents[alone]], self.one_node[parents[alone]] = read[alone], nodes[alone]
        self.row[n > 1] = np.arange(1, (n > 1).sum() + 1)
        self.rows = np.full(((n > 1).sum() + 1, width), -1, "int32")
        self.rows[self.row[parents[~alone]], read[~alone]] = nodes[~alone]
        self.pairs, self.apart = np.full(1 << PAIR_BITS, -1, "int64"), np.zeros(1 << PAIR_BITS, bool)

    def _whole(self, nodes: np.ndarray) -> np.ndarray:
        found = self.whole[nodes]
        if (found < 0).any():
            for node in np.unique(nodes[found < 0]).tolist():
                self.whole[node] = self.merges.whole(self.names[node])
            found = self.whole[nodes]
        return found > 0

    def _neighbours(self, before: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Which pairs may stand side by side. A pair is remembered in the place its hash names, until another needs it."""
        n = len(self.names)
        place = lambda keys: ((keys.view("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).view("int64")
        keys = before.astype("int64") * n + nodes
        at = place(keys)
        good, new = self.apart[at], self.pairs[at] != keys
        if new.any():
            asked, which = np.unique(keys[new], return_inverse=True)
            found = np.array([self.merges.neighbours(self.names[k // n], self.names[k % n]) for k in asked.tolist()], bool)
            good[new] = found[which]
            at = place(asked)
            self.pairs[at], self.apart[at] = asked, found
            lost = self.pairs[at] != asked  # of two in one place one stays, with its own answer
            self.pairs[at[lost]] = -1
        return good

    def read(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word's tokens; no word is empty or longer than ``lookahead``."""
        sizes = np.fromiter(map(len, words), "int64", len(words))
        order = np.argsort(-sizes, kind="stable")
        data, starts = np.frombuffer(b"".join(words), "uint8"), np.cumsum(sizes) - sizes
        sizes, starts, most = sizes[order], starts[order], int(sizes.max())
        symbols = np.zeros((most, len(words)), "int16")
        for p in range(most):
            n = np.searchsorted(-sizes, -p)  # longer ones come first
            symbols[p, :n] = data[starts[:n] + p]
        symbols[sizes - 1, np.arange(len(words))] += self.last
        root, none = -1, -2
        tokens, lengths = np.full((most + 1, len(words)), none, "int32"), np.zeros((most + 1, len(words)), "int8")
        tokens[0] = root
        for p in range(most):
            w = np.arange(np.searchsorted(-sizes, -p))
            nodes = symbols[p, w].astype("int32")
            for size in range(1, p + 2):
                before = tokens[p + 1 - size, w]
                good = before != none
                good[good] = self._whole(nodes[good])
                ask = np.flatnonzero(good & (before != root))
                good[ask] = self._neighbours(before[ask], nodes[ask])
                tokens[p + 1, w[good]], lengths[p + 1, w[good]] = nodes[good], size
                if size == p + 1:
                    break
                w, nodes = w[~good], nodes[~good]
                s = symbols[p - size, w]
                nodes = np.where(self.one[nodes] == s, self.one_node[nodes], self.rows[self.row[nodes], s])
                w, nodes = w[nodes >= 0], nodes[nodes >= 0]
                if not len(w):
                    break
        at, columns, out = sizes, np.arange(len(words)), []
        while (at > 0).any():  # from the last token to the first
            out.append(np.where(at > 0, self.ids[tokens[at, columns]], -1))
            at = at - lengths[at, columns]
        out = np.array(out[::-1]).T
        flat, found = iter(out[out >= 0].tolist()), [()] * len(words)
        for w, n in zip(order.tolist(), (out >= 0).sum(axis=1).tolist(), strict=True):
            found[w] = tuple(islice(flat, n))
        return found


class Tokenizer:
    """Reads a tokenizer file: normalizer steps, one split pattern, byte-level symbols, merges, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.steps = self._steps(spec.get("normalizer"))
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(self.pattern, regex.V0)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = byte_symbols()
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.shown = {i: str(i) for i in self.names}
        self.side_by_side = SideBySide(self.merges, self.bytes)
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _steps(spec: dict | None) -> list[str]:
        return [] if not spec else [s["type"] for s in spec.get("normalizers", [spec])]

    def normal(self, text: str) -> str:
        if "NFC" in self.steps and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.steps:
            text = text.replace("Σ", "σ").lower()  # each character by itself: no final sigma
        return text

    def _word(self, word: str) -> tuple[int, ...]:
        vocab = self.merges.vocab
        return tuple([vocab[t] for t in self.merges.tokens("".join(map(self.bytes.__getitem__, word.encode()))) if t in vocab])

    def _learn(self, words: set[str]) -> list[str]:
        """Put what isn't remembered of some words there, short new ones read side by side if they are many; the long ones, which shall not stay.

        Two generations: words that are met again outlast the older one.
        """
        if len(self._known) > REMEMBERED:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        new = words.difference(known)
        met = new.intersection(older)
        known.update(zip(met, map(older.__getitem__, met), strict=True))
        new -= met
        short = {w: b for w in new if len(b := w.encode()) <= self.merges.lookahead}
        if len(short) >= FEW:
            known.update(zip(short, self.side_by_side.read(list(short.values())), strict=True))
            new.difference_update(short)
        known.update((w, self._word(w)) for w in new)
        return [w for w in new if len(w) > 64]

    def _stretches(self, text: str) -> Iterator[tuple[int, list[str] | int]]:
        """Words in lists of at most FLUSH, or the id of a special token, with the characters read for them. Neither crosses white space, so long texts are read in stretches that end there."""
        at = 0
        while at < len(text):
            m = BLANK.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            end = m.end() if m else len(text)
            stretch = text[at:end]
            at = end
            for part in self.marks.split(stretch) if self.marks and self.marks.search(stretch) else (stretch,):
                if part in self.special:
                    yield len(part), self.special[part]
                elif part:
                    words = self.words.findall(self.normal(part))
                    for k in range(0, len(words), FLUSH):
                        yield len(part) if not k else 0, words[k : k + FLUSH]

    def batches(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[int]]]:
        """The texts' ids, in lists of a few thousand, each with its text's place. Texts of HELD characters wait for their new words, which are read together."""
        held, size = [], 0
        for row, text in enumerate(texts):
            for n, some in self._stretches(text) if text else ():
                held.append((row, some))
                size += n
                if size >= HELD:
                    yield from self._ready(held)
                    held, size = [], 0
        yield from self._ready(held)

    def _ready(self, held: list[tuple[int, list[str] | int]]) -> Iterator[tuple[int, list[int]]]:
        long = self._learn(set().union(*(some for _, some in held if isinstance(some, list))))
        ids = self._known.__getitem__
        for row, some in held:
            yield row, list(chain.from_iterable(map(ids, some))) if isinstance(some, list) else [some]
        for w in long:
            del self._known[w]

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in self.batches([text]) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        machine = Decoder(self)
        return machine.feed(ids) + machine.end()


class Decoder:
    """Ids to text, batch by batch. Without a decoder in the file, token names stand with a space between; with the byte-level
    decoder, bytes go through an incremental UTF-8 machine that holds at most three bytes. Unknown ids have no text."""

    def __init__(self, tok: Tokenizer):
        self.names, self.begun = tok.names, False
        self.value = {c: b for b, c in enumerate(tok.bytes)} if tok.decoder == "ByteLevel" else None
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        names, value = self.names, self.value
        if value is not None:
            return self.machine.decode(bytes(value[c] for i in ids for c in names.get(i, "") if c in value))
        try:
            found = list(map(names.__getitem__, ids))
        except KeyError:
            found = [names[i] for i in ids if i in names]
        begun, self.begun = self.begun, self.begun or bool(found)
        return (" " if begun and found else "") + " ".join(found)

    def end(self) -> str:
        return self.machine.decode(b"", True) if self.value is not None else ""


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; one pass, no shuffle."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # the remembered tuples hold no cycles, and looking for some takes a seventh of the time
        try:
            for pdf in batches:
                yield digests(load(path), pdf)
        finally:
            gc.enable()

    def digests(tok: Tokenizer, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(0, EMPTY, EMPTY)] * len(pdf)
        for row, parts in groupby(tok.batches(pdf["text"]), itemgetter(0)):
            n, ids_digest, text_digest, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(tok)
            for _, ids in parts:
                if ids:
                    ids_digest.update(((" " if n else "") + " ".join(map(tok.shown.__getitem__, ids))).encode())
                    text_digest.update(machine.feed(ids).encode())
                    n += len(ids)
            text_digest.update(machine.end().encode())
            rows[row] = n, ids_digest.hexdigest(), text_digest.hexdigest()
        out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        out.insert(0, "doc_id", pdf["doc_id"].values)
        return out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, the token ids as an array, and the decoded text."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = load(path)
        for pdf in batches:
            ids = [tok.encode(t) if t else [] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].values, "ids": ids, "decoded": [tok.decode(i) for i in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, ids array<int>, decoded string")


def op6_bpe(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"))
