"""SentencePiece encoding: distinct sampled segmentations by perturbed A-star, and decoding.

A text's segmentations form a lattice; the probability of one is proportional to the product
of its pieces'. Gumbel top-k takes ``k`` of them without replacement: every segmentation's
log-probability is perturbed by Gumbel noise and the k largest win. They are found without
listing the lattice. The noise of a whole subtree's best member is again Gumbel, so A-star
search pops the best subtree, walks it down to its winner, and puts back the subtrees it
passed, each with the (truncated) noise of its own best member: the bounds are exact, and
every walk ends in a sample. Along with it goes its log inclusion score
``log(1 - exp(-exp(log p - kappa)))``, ``kappa`` being the best perturbed value left over.

Pieces never cross the start of a word, so the lattice of a text is a chain of word
lattices; equal words of a batch share theirs. Arrays hold the lattices and the walks of
all texts of a batch. Noise is drawn from a hash of the row's key, the sample and the place
in the text: the same row gives the same samples in any partitioning.

The vocabulary of a merge-ordered model has ranks, no probabilities: a piece of rank r gets
``1 / (r + RANK_SHIFT)`` of the mass, a byte the share of the last rank, to the power of
``sharpness``. Characters without a piece are written as bytes. A literal U+2581, which
the library reads back as a blank, is written as bytes too, so decoding restores every text.

Defined cases: null and empty texts have one segmentation, of no pieces; texts with fewer
than ``k`` segmentations give all of them, with inclusion 1 (log 0); rows with a null key
are keyed by 0; repeated rows give repeated samples; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.hashing import mix

BLANK, LITERAL = 0x2581, 0x110001
RANK_SHIFT = 10.0
BATCH_CHARS = 600_000  # characters whose lattices a worker holds at a time
DECODE_ROWS = 128
LONE = 2**63
RESULT = (
    "row_key long, rank int, n_pieces long, log_prob double, perturbed double, "
    "log_inclusion double, ids array<int>"
)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _power_table(base: int, bits: int) -> np.ndarray:
    grown = np.full(2**bits, base, np.uint64)
    grown[0] = 1
    return np.multiply.accumulate(grown)


def _powers(base: int, n: int) -> np.ndarray:
    return _power_table(base, max(n.bit_length(), 20))[:n]


@lru_cache(maxsize=1)
def _mixed_codes() -> np.ndarray:
    """A random number of every code point."""
    return mix(np.arange(1, LITERAL + 2, dtype=np.uint64))


class CodeHash:
    """Hashes of windows of code points: the numbers of their code points times powers of the base."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed_codes()[codes] * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 2**64), n + 1)

    def between(self, starts, ends):
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


class Lookup:
    """Values by hash. A key's slot is told by its first bits; slots are eight times the keys,
    so few keys share one, and a key is found without a search."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        bits = max(len(hashes) * 8, 2).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = hashes[order], values[order]
        slots = (self.keys >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(slots, np.arange(2**bits + 1)).astype(np.int32)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the places of ``asked`` that have a value, the values)"""
        slot = (asked >> self.shift).view(np.int64)
        at, stop = self.begin[slot], self.begin[slot + 1]
        places = np.flatnonzero(at < stop)
        at, stop = at[places].astype(np.int64), stop[places]
        hit = self.keys[at] == asked[places]
        rest = np.flatnonzero(~hit & (at + 1 < stop))
        while len(rest):
            at[rest] += 1
            hit[rest] = self.keys[at[rest]] == asked[places[rest]]
            rest = rest[~hit[rest] & (at[rest] + 1 < stop[rest])]
        found = np.flatnonzero(hit)
        return places[found], self.values[at[found]]


class Vocabulary:
    """Pieces of a SentencePiece model as tables."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.bytes_of = [b""] * size
        self.byte_ids = np.zeros(256, np.int32)
        normal = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append((-model.get_score(i), i, piece))
                self.bytes_of[i] = piece.replace(chr(BLANK), " ").encode()
        normal.sort()
        ranks = np.arange(len(normal)) + RANK_SHIFT
        total = np.log((1 / ranks).sum())
        self.log_p = np.zeros(size)
        for rank, (_, i, _) in enumerate(normal):
            self.log_p[i] = sharpness * (-np.log(rank + RANK_SHIFT) - total)
        self.byte_log_p = sharpness * (-np.log(len(normal) + RANK_SHIFT) - total)
        # By length: hashes of everything a piece begins with, and the piece that is just that.
        beginnings: dict[int, dict[str, int]] = {}
        for _, i, piece in normal:
            for length in range(1, len(piece)):
                beginnings.setdefault(length, {}).setdefault(piece[:length], -1)
            beginnings.setdefault(len(piece), {})[piece] = i
        self.tables = []
        for length, held in sorted(beginnings.items()):
            codes = np.array([[ord(c) for c in p] for p in held], np.uint32)
            at = np.arange(len(held)) * length
            hashes = CodeHash(codes.ravel()).between(at, at + length)
            self.tables.append(Lookup(hashes, np.array(list(held.values()), np.int32)))
        # By code point: the piece of one character, -1 if none; and whether any piece has it.
        self.single = np.full(0x110002, -1, np.int32)
        for piece, i in beginnings[1].items():
            self.single[ord(piece)] = i
        self.known = np.zeros(0x110002, bool)
        self.known[[ord(c) for _, _, p in normal for c in p]] = True
        inner = [p for _, _, p in normal if p.strip(chr(BLANK)) and chr(BLANK) in p.lstrip(chr(BLANK))]
        self.by_words = not inner  # no piece goes on after a word has begun and ended
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])


@lru_cache(maxsize=4)
def _vocabulary(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


def _codes(text: str) -> np.ndarray:
    """Code points of the text as the model sees it: a blank before it, blanks marked."""
    codes = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32).copy()
    codes[codes == BLANK] = LITERAL
    codes[codes == 0x20] = BLANK
    return codes


def _ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[0] … begins[0]+counts[0]-1, begins[1] …"""
    ends = np.cumsum(counts)
    return np.repeat(begins - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Lattices:
    """The word lattices of a batch of texts, equal words once.

    A node is a character of a distinct word. Nodes go by the number of characters that are
    left, most first, and within that by word, longest first: what a node's chances need comes
    after it, and the nodes of one step of a recursion stand together. The end of all words is
    one node, the last."""

    def __init__(self, vocabulary: Vocabulary, texts: list[np.ndarray]):
        self.vocabulary = vocabulary
        codes = np.concatenate(texts)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        blank, known = codes == BLANK, vocabulary.known[codes]
        cut = np.zeros(len(codes), bool)
        if vocabulary.by_words:
            cut[1:] |= blank[1:] & ~blank[:-1]
        cut[1:] |= ~known[1:] | ~known[:-1]  # characters without a piece stand alone
        cut[begins[begins < len(codes)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(codes))[: len(starts)]
        names = CodeHash(codes).between(starts, ends)
        order = np.argsort(names)
        new = np.ones(len(names), bool)
        new[1:] = names[order[1:]] != names[order[:-1]]
        first = order[new]
        sizes = (ends - starts)[first]
        longest = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(first), np.int64)
        rank[longest] = np.arange(len(first))
        self.word_of = np.empty(len(names), np.int64)
        self.word_of[order] = rank[np.cumsum(new) - 1]
        self.word_begin, self.word_end = starts, ends  # places of every word in the batch
        self.first_word = np.searchsorted(starts, begins)  # of every text, and the end
        self.text_begin = begins
        first, sizes = first[longest], sizes[longest]
        # By characters left: how many words have that many, and where their nodes begin.
        having = np.cumsum(np.bincount(sizes, minlength=1)[::-1])[::-1]
        having[:1] = 0
        n = int(having.sum())
        self.level = n - np.cumsum(having)
        node = np.arange(n)
        self.left = np.append(np.repeat(np.arange(len(having))[::-1], having[::-1]), 0)
        left = self.left[:-1]
        self.codes = codes[ends[first[node - self.level[left]]] - left]
        self.next = np.minimum(node + having[left], n)
        self.node = np.append(self.level[sizes] + np.arange(len(sizes)), n)  # of every word, and the end
        self._edges()
        self._chances()

    def _edges(self) -> None:
        v, n = self.vocabulary, len(self.codes)
        numbers = _mixed_codes()[self.codes]
        lone = np.ones(n, bool)
        count = np.zeros(n, np.int64)
        found = []
        at = np.flatnonzero(v.known[self.codes])
        piece, hashes, place = v.single[self.codes[at]], numbers[at], at
        lone[at[piece >= 0]] = False
        for length, table in enumerate(v.tables, 1):
            # Here ``at`` begins what some piece begins with, and ``place`` is its last character.
            if length > 1:
                begun, piece = table.find(hashes)
                at, place, hashes = at[begun], place[begun], hashes[begun]
            place = self.next[place]
            whole = np.flatnonzero(piece >= 0)
            start = at[whole]
            found.append((start, count[start], place[whole], piece[whole], length))
            count[start] += 1
            room = np.flatnonzero(place < n)
            if not len(room):
                break
            at, place = at[room], place[room]
            hashes = hashes[room] + numbers[place] * _powers(_BASE, length + 1)[length]
        lone = np.flatnonzero(lone)
        found.append((lone, count[lone], self.next[lone], np.full(len(lone), -1, np.int32), 1))
        count[lone] += 1
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.start = np.repeat(np.arange(n), count)
        self.only = np.repeat(count == 1, count)  # no other edge leaves the node
        self.end, piece, self.length = (np.empty(self.first[-1], t) for t in (np.int64, np.int32, np.int64))
        for start, before, end, what, length in found:
            edge = self.first[start] + before
            self.end[edge], piece[edge], self.length[edge] = end, what, length
        # Ids of an edge: a piece, or the bytes of a character.
        as_bytes = np.flatnonzero(piece < 0)
        written = [
            chr(BLANK if c == LITERAL else c).encode("utf-8", "surrogatepass")
            for c in self.codes[self.start[as_bytes]].tolist()
        ]
        self.n_ids = np.ones(len(piece), np.int32)
        self.n_ids[as_bytes] = [len(w) for w in written]
        self.log_p = v.log_p[piece]
        self.log_p[as_bytes] = self.n_ids[as_bytes] * v.byte_log_p
        self.piece = piece
        # Of edges that are bytes, the first id stands in ``piece`` and all of them from ``id_at`` on.
        self.id_at, self.byte_edges = np.zeros(len(as_bytes), np.int64), as_bytes
        self.byte_ids = v.byte_ids[np.frombuffer(b"".join(written), np.uint8)]
        if len(written):
            self.id_at[1:] = np.cumsum(self.n_ids[as_bytes])[:-1]
            piece[as_bytes] = self.byte_ids[self.id_at]

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each of ``edges``, all ids in order)"""
        counts = self.n_ids[edges]
        ids = self.piece[edges]
        many = np.flatnonzero(counts > 1)
        if len(many):
            begin = (np.cumsum(counts) - counts)[many]
            ids = np.repeat(ids, counts)
            source = self.id_at[np.searchsorted(self.byte_edges, edges[many])]
            ids[_ragged(begin, counts[many])] = self.byte_ids[_ragged(source, counts[many])]
        return counts, ids

    def _chances(self) -> None:
        """Probability of each edge among those of its node, given all that can follow."""
        ahead = np.zeros(len(self.codes) + 1)
        self.log_chance, self.upto = np.empty(len(self.end)), np.empty(len(self.end))
        stop = len(self.codes)
        for begin in self.level[1:].tolist():
            edges = slice(self.first[begin], self.first[stop])
            first = self.first[begin:stop] - self.first[begin]
            of = self.start[edges] - begin
            value = self.log_p[edges] + ahead[self.end[edges]]
            top = np.maximum.reduceat(value, first)
            chance = np.exp(value - top[of])
            total = np.add.reduceat(chance, first)
            ahead[begin:stop] = whole = top + np.log(total)
            np.subtract(value, whole[of], out=self.log_chance[edges])
            chance /= total[of]
            upto = np.cumsum(chance)
            np.subtract(upto, (upto - chance)[first][of], out=self.upto[edges])
            stop = begin
        self.upto[self.first[1:] - 1] = 2.0

    def walk(self, nodes: np.ndarray, keys: np.ndarray, places: np.ndarray):
        """(number of steps of each walk, all edges in order) of random walks from ``nodes``
        to the ends of their words. ``keys`` are the noise keys of the words' texts, ``places``
        the nodes' places in their texts."""
        end = len(self.codes)
        active = np.flatnonzero(nodes < end)
        at, key, place = nodes[active], keys[active], places[active]
        steps = np.zeros(len(nodes), np.int64)
        taken = []
        while len(active):
            draw = uniform(key, place)
            edge = self.first[at]
            more = np.flatnonzero(draw > self.upto[edge])
            draw = draw[more]
            while len(more):
                edge[more] += 1
                still = np.flatnonzero(draw > self.upto[edge[more]])
                more, draw = more[still], draw[still]
            taken.append((active, edge))
            steps[active] += 1
            at = self.end[edge]
            on = np.flatnonzero(at < end)
            place = place[on] + self.length[edge[on]]
            active, at, key = active[on], at[on], key[on]
        begin = np.concatenate([[0], np.cumsum(steps)])
        edges = np.empty(begin[-1], np.int64)
        for step, (who, edge) in enumerate(taken):
            edges[begin[who] + step] = edge
        return steps, edges


def uniform(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from a key and a counter."""
    mixed = mix(keys ^ (places.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1)))
    drawn = (mixed >> np.uint64(11)).astype(np.float64)
    drawn += 0.5
    drawn *= 2.0**-53
    return drawn


def _truncated(location, bound, draw):
    """Gumbel noise at ``location``, given that it stays below ``bound``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        free = location - np.log(-np.log(draw))
        value = np.minimum(bound, free) - np.log1p(np.exp(-np.abs(bound - free)))
    return np.where(np.isneginf(location), -np.inf, value)


class Path:
    """A sampled segmentation of one text. ``lost`` has the log-probability of what comes before
    each of its edges, its sign turned, and ``value`` the noise of the subtrees its walk passed
    from ``since`` on, as far as one of them can win."""

    def __init__(self, edges, lost, log_prob, since, value, perturbed):
        self.edges, self.lost, self.log_prob = edges, lost, log_prob
        self.since, self.value, self.perturbed = since, value, perturbed
        self.out: dict[int, list[int]] = {}  # edges that are gone from a passed subtree


class Search:
    """The A-star search of one text."""

    def __init__(self):
        self.paths: list[Path] = []

    def best(self) -> tuple[float, int, int]:
        """(value, path, step) of the best subtree that is left."""
        top = (-np.inf, -1, -1)
        for number, path in enumerate(self.paths):
            if len(path.value):
                step = int(path.value.argmax())
                if path.value[step] > top[0]:
                    top = (float(path.value[step]), number, path.since + step)
        return top

    def branch(self, lattices: Lattices, number: int, step: int, draw: float) -> tuple[int, float]:
        """Takes an edge, drawn by chance, out of a subtree. (the edge, log of what is left)"""
        path, m = self.paths[number], lattices
        gone = path.out.setdefault(step, [int(path.edges[step])])
        node = m.start[gone[0]]
        open_ = [e for e in range(int(m.first[node]), int(m.first[node + 1])) if e not in gone]
        chance = np.exp(m.log_chance[open_])
        whole = chance.sum()
        chosen = min(int(chance.cumsum().searchsorted(draw * whole)), len(open_) - 1)
        gone.append(open_[chosen])
        rest = whole - chance[chosen]
        return open_[chosen], np.log(rest) if len(open_) > 1 and rest > 0 else -np.inf


def noise_keys(keys: np.ndarray, sample: int) -> np.ndarray:
    return mix(mix(keys.astype(np.int64).view(np.uint64)) + np.uint64(sample * 7919 + 17))


# Noise lies between -4 and 38. Where more than k subtrees are within NEAR of the best location,
# one that is FAR below it cannot win, and needs no noise.
NEAR, FAR = 50.0, 100.0


def _add_paths(m: Lattices, searches: list[Search], keys, edges, ends, since, perturbed, k: int) -> None:
    """Gives every search a path: its part of ``edges``, with the noise of what it passed."""
    log_chance = m.log_chance[edges]
    lost = np.empty(len(edges))
    begin, first, stop = ends[:-1], ends[:-1] + since, ends[1:].copy()
    for i, (a, f, b) in enumerate(zip(begin.tolist(), first.tolist(), ends[1:].tolist(), strict=True)):
        part = lost[a:b]
        np.cumsum(log_chance[a:b], out=part)  # text by text, so that a sum is the same in any batch
        log_prob = float(part[-1]) if a < b else 0.0
        np.subtract(log_chance[a:b], part, out=part)
        if f < b:
            stop[i] = f + part[f - a :].searchsorted(part[f - a] + NEAR + FAR)
        searches[i].paths.append(Path(edges[a:b], part, log_prob, int(since[i]), part[:0], float(perturbed[i])))
    full = ends[1:]
    for _ in range(2):
        counts = stop - first
        at = _ragged(first, counts)
        chance = np.minimum(np.exp(log_chance[at]), 1.0 - 1e-16)
        location = np.where(m.only[edges[at]], -np.inf, np.log1p(-chance)) - lost[at]
        some = np.flatnonzero(counts)
        where = (np.cumsum(counts) - counts)[some]
        if not len(some):
            return
        most = np.maximum.reduceat(location, where)
        near = np.add.reduceat(location >= np.repeat(most - NEAR, counts[some]), where, dtype=np.int64)
        short = some[((near <= k) | (most < -lost[first[some]] - NEAR)) & (stop[some] < full[some])]
        if not len(short):
            break
        stop[short] = full[short]  # the rest of these paths counts too
    noise = uniform(np.repeat(keys, counts), at - np.repeat(begin, counts))
    value = _truncated(location, np.repeat(perturbed, counts), noise)
    for i, a, n in zip(some.tolist(), where.tolist(), counts[some].tolist(), strict=True):
        searches[i].paths[-1].value = value[a : a + n]


def sample_batch(vocabulary: Vocabulary, keys: np.ndarray, texts: list[str], k: int):
    """Per text a search with its paths, best first; the lattices."""
    m = Lattices(vocabulary, [_codes(t) if t else np.zeros(0, np.uint32) for t in texts])
    searches = [Search() for _ in texts]
    root = -np.log(-np.log(uniform(noise_keys(keys, 0), np.zeros(len(keys), np.int64))))

    def walk(texts_: np.ndarray, words: np.ndarray, nodes: np.ndarray, sample: int):
        """Walks for words that belong to ``texts_`` (one entry per word)."""
        place = m.word_end[words] - m.left[nodes] - m.text_begin[texts_]
        return m.walk(nodes, noise_keys(keys, 1 + sample)[texts_], place)

    owner = np.repeat(np.arange(len(texts)), np.diff(m.first_word))
    steps, edges = walk(owner, np.arange(len(owner)), m.node[m.word_of], 0)
    ends = np.concatenate([[0], np.cumsum(steps)])[m.first_word]
    _add_paths(m, searches, noise_keys(keys, 1000), edges, ends, np.zeros(len(texts), np.int64), root, k)
    for sample in range(1, k):
        tops = [s.best() if len(s.paths) == sample else (-np.inf, -1, -1) for s in searches]
        whose = np.flatnonzero([value > -np.inf for value, _, _ in tops])
        if not len(whose):
            break
        value, number, step = map(np.array, zip(*(tops[t] for t in whose), strict=True))
        key = noise_keys(keys, 2000 + sample)[whose]
        draw, again = uniform(key, step), uniform(key, np.uint64(LONE - 1) - step.astype(np.uint64))
        going = [searches[t] for t in whose]
        asked = list(zip(going, number.tolist(), step.tolist(), strict=True))
        drawn = [s.branch(m, i, at, d) for (s, i, at), d in zip(asked, draw.tolist(), strict=True)]
        first, rest = map(np.array, zip(*drawn, strict=True))
        before = np.array([s.paths[i].lost[at] for s, i, at in asked])
        prefixes = []
        for (s, i, at), left in zip(asked, _truncated(rest - before, value, again), strict=True):
            path = s.paths[i]
            path.value[at - path.since] = left
            prefixes.append(path.edges[:at])
        along = np.array([int(m.length[p].sum()) for p in prefixes]) + m.text_begin[whose]
        word = np.searchsorted(m.word_begin, along, side="right") - 1
        count = m.first_word[whose + 1] - word
        words = _ragged(word, count)
        nodes = m.node[m.word_of[words]]
        begin = np.cumsum(count) - count
        nodes[begin] = m.end[first]
        steps, edges = walk(np.repeat(whose, count), words, nodes, sample)
        cuts = np.concatenate([[0], np.cumsum(steps)])[np.append(begin, len(words))]
        parts = []
        for i, prefix in enumerate(prefixes):
            parts += [prefix, first[i : i + 1], edges[cuts[i] : cuts[i + 1]]]
        ends = np.concatenate([[0], np.cumsum(step + 1 + np.diff(cuts))])
        key = noise_keys(keys, 1000 + sample)[whose]
        _add_paths(m, going, key, np.concatenate(parts), ends, step + 1, value, k)
    return m, searches


def encode_samples(
    docs: DataFrame,
    model: str,
    k: int = 2,
    sharpness: float = 1.0,
    key_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key_col, rank, n_pieces, log_prob, perturbed, log_inclusion, ids, *keep): up to ``k``
    rows per row of ``docs``, rank 1 first, with its columns ``keep``. ``model`` is a file that
    every executor can open."""
    kept = [docs.schema[c] for c in keep]

    def rows_of(keys: list, texts: list[str], rest: list[pa.Array]) -> pa.RecordBatch:
        plain = np.array([0 if x is None else x for x in keys], np.int64)
        m, searches = sample_batch(_vocabulary(model, sharpness), plain, texts, k)
        counts = np.array([len(s.paths) for s in searches])
        paths = [p for s in searches for p in s.paths]
        which = pa.array(np.repeat(np.arange(len(searches)), counts))
        rank = _ragged(np.ones(len(searches), np.int64), counts)
        log_prob, perturbed = np.array([(p.log_prob, p.perturbed) for p in paths]).T.copy()
        behind = log_prob - np.array([s.best()[0] for s in searches])[which.to_numpy()]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            gap = np.exp(behind)  # of rows with nothing left: infinite
            inclusion = np.where(gap > 1e-12, np.log(-np.expm1(-gap)), behind)
        n_ids, ids = m.ids(np.concatenate([p.edges for p in paths]))
        lengths = np.array([len(p.edges) for p in paths])
        pieces = np.concatenate([[0], np.cumsum(n_ids)])[np.concatenate([[0], np.cumsum(lengths)])]
        lists = pa.ListArray.from_arrays(pa.array(pieces, pa.int32()), pa.array(ids, pa.int32()))
        arrays = [
            pa.array(keys, pa.int64()).take(which), pa.array(rank, pa.int32()), pa.array(np.diff(pieces), pa.int64()),
            *[pa.array(c, pa.float64()) for c in (log_prob, perturbed, inclusion)], lists, *[a.take(which) for a in rest],
        ]
        return pa.RecordBatch.from_arrays(arrays, names=[*[f.split()[0] for f in RESULT.split(", ")], *keep])

    def run(batches):
        for batch in batches:
            keys, texts, size, begin = [], [], 0, 0

            def rest(begin: int, n: int, batch=batch) -> list[pa.Array]:
                return [c.slice(begin, n) for c in batch.columns[2:]]

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    yield rows_of(keys, texts, rest(begin, len(keys)))
                    begin += len(keys)
                    keys, texts, size = [], [], 0
            if keys:
                yield rows_of(keys, texts, rest(begin, len(keys)))
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(key_col).cast("long"), text_col, *keep)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, RESULT + more).withColumnRenamed("row_key", key_col)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """All columns but ``ids_col``, and ``text``: the pieces joined, bytes read as UTF-8, the
    blank before the text taken off."""
    kept = [f for f in encoded.schema.fields if f.name != ids_col]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "text string"])

    def run(batches):
        v = _vocabulary(model, 1.0)
        size = np.diff(v.begin)
        for whole in batches:
            for at in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(at, DECODE_ROWS)
                lists = batch.column(len(kept))
                ids = lists.flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                joined = v.flat[_ragged(v.begin[ids], size[ids])].tobytes()
                cuts = np.concatenate([[0], np.cumsum(size[ids])])[ends].tolist()
                texts = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    text = joined[a:b].decode("utf-8", "replace")
                    texts.append(text[1:] if text[:1] == " " else text)
                arrays = [*batch.columns[: len(kept)], pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*[f.name for f in kept], "text"])

    return encoded.select(*[f"`{f.name}`" for f in kept], ids_col).mapInArrow(run, schema)
