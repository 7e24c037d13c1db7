"""Language-model scoring: a causal self-attention model in numpy on subword ids, beside smoothed word counts.

One pass turns texts into blocks: the distinct words of a block (with their subword ids, by a public vocabulary) and its documents (as numbers of those
words). Word counts are summed over all training rows. In the model a place is a word, whose vector is the mean of its subwords' vectors; attention over the
places before, in overlapping windows, gives each next word's first subword: its group, then its class, then by its share of the class. Groups hold
subwords that begin words in similar texts (of one language, for example). The subwords within a word, and where it ends, follow from counts of neighbours
in words of the first one's group. So the probabilities of all words sum to 1 at each place. The network is trained on executors in rounds, whose
parameters are averaged; each training row takes part in one round, with all its windows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored
from .flat import LOWER, NOT_SPACE, chunks, words
from .tokens import pattern, ranked

#: Width of vectors; classes of subwords in context; groups of first subwords, and classes of a group; places of a window, and how many of them are scored.
DIM, INPUTS, GROUPS, EACH, SPAN, STRIDE = 16, 2048, 8, 32, 32, 24
#: Classes of subwords within words; numbers that describe the texts in which a subword begins words.
INNER, SIGNS = 768, 8
OUTPUTS, BEFORE = GROUPS * EACH, SPAN - STRIDE
#: A document takes part in round k of training if its hash modulo ROUNDS is k. Windows of a step: the first SOON steps of a task have FEW, the next ones twice as many, and so on up to BATCH.
ROUNDS, BATCH, FEW, SOON = 2, 128, 4, 32
SHAPES = {"emb": (INPUTS + 1, DIM), "pos": (SPAN, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM), "u": (DIM, GROUPS), "c": (1, GROUPS), "w": (DIM, OUTPUTS), "d": (1, OUTPUTS)}

#: Rows: a block of texts; its words by part of their hash, to be counted; counts of subwords.
TEXTS, PARTS, COUNTS = 0, 1, 2
SCHEMA = "kind int, block long, part int, key long, n long, a binary, b binary, c binary, d binary, e binary"
#: In a block's marks a document's round of training, or this.
HELD = 255


def packed(x: np.ndarray) -> bytes:
    """Numbers compressed, their lowest bytes first."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()) if len(x) else b""


def unpacked(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def blocks(docs: DataFrame, tokenizer: str, parts: int, limit: int = 8_000_000) -> DataFrame:
    """docs: doc_id, held_out, text. A null text has no words. Rows by kind:

    TEXTS a block (a: doc_ids, null as the least number; b: words of each document u32, then marks u8; c: the words by number; d: how many subwords each word has; e: their
    ids u16, then the places of words in the order of hashes u32, n: how many ids); PARTS a block's words whose hash falls into one of `parts`, in that order from place `key` on (a: hashes, b:
    counts in training rows); COUNTS of a task's training rows (key: a subword id; 65536 + id, words that begin with it; 131072 + SIGNS * id + k, number k
    of the texts around those words, summed, in millionths).
    """
    cut_by = pattern()
    names = ("kind", "block", "part", "key", "n", "a", "b", "c", "d", "e")
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5)

    def rows(m: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(m, k) for c, k in zip(names, kinds, strict=True)], names=list(names))

    def run(batches):
        from pyspark import TaskContext

        encode = ranked(tokenizer, cut_by)
        block = TaskContext.get().partitionId() << 24
        signs = np.random.default_rng(5).standard_normal((SIGNS, 65536)).astype(np.float32)
        sums, around = np.zeros(131072, np.int64), np.zeros((65536, SIGNS), np.int64)
        for batch in batches:
            for t in chunks([batch], limit, forget=False):
                begin, end, h = words(t, NOT_SPACE, LOWER)
                known, first, own = np.unique(h, return_index=True, return_inverse=True)
                at = np.searchsorted(begin, np.append(t.starts, t.size))
                each = np.diff(at)
                held = np.array([bool(x) for x in t.rows.column("held_out").to_pylist()])
                marks = np.where(held, HELD, t.rows.column("turn").to_numpy()).astype(np.uint8)
                n = np.bincount(own[np.repeat(~held, each)], minlength=len(known))
                low = LOWER[t.buf].tobytes()
                # words are numbered by falling count in the documents, so that the numbers are small and pack well
                order = np.argsort(-np.bincount(own, minlength=len(known)), kind="stable")
                rank = np.empty(len(order), "<u4")
                rank[order] = np.arange(len(order))
                first = first[order]
                lens, flat = encode([low[i:j].decode("utf-8", "replace") for i, j in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
                flat = flat.astype("<u2")
                del low, begin, end, h
                firsts, n_words = flat[np.cumsum(lens) - lens].astype(np.int64), n[order]
                sums[:65536] += np.bincount(flat, np.repeat(n_words, lens), minlength=65536).astype(np.int64)
                sums[65536:] += np.bincount(firsts, n_words, minlength=65536).astype(np.int64)
                numbers = rank[own].astype(np.int64)
                full = np.flatnonzero(each > 0)
                begin, learnt = at[:-1][full], (~held[full]).astype(np.float32)
                for k in range(SIGNS):  # a text's number is the mean of its words'; a word gets those of the texts that it occurs in
                    text = np.add.reduceat(signs[k][firsts][numbers], begin) / each[full] * learnt if len(full) else signs[0, :0]
                    word = np.bincount(numbers, np.repeat(text, each[full]), minlength=len(known))
                    around[:, k] += np.rint(np.bincount(firsts, word, minlength=65536) * 1e6).astype(np.int64)
                doc_ids = t.rows.column("doc_id").fill_null(NULL).to_numpy().astype("<i8")
                yield rows(1, kind=[TEXTS], block=[block], n=[len(flat)], a=[packed(doc_ids)], b=[each.astype("<u4").tobytes() + marks.tobytes()], c=[packed(numbers.astype("<u4"))], d=[packed(lens.astype("<u4"))], e=[flat.tobytes() + order.astype("<u4").tobytes()])
                # np.unique sorts: words of one part, by the hash's upper bits, stand together
                part = ((known >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                ends = np.searchsorted(part, np.arange(parts + 1))
                full = np.flatnonzero(np.diff(ends))
                cut = [(int(ends[k]), int(ends[k + 1])) for k in full]
                yield rows(len(full), kind=[PARTS] * len(full), block=[block] * len(full), part=full, a=[known[i:j].tobytes() for i, j in cut], b=[packed(n[i:j].astype("<u4")) for i, j in cut], key=[i for i, _ in cut])
                block += 1
        total = np.concatenate((sums, around.ravel()))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield rows(len(part), kind=[COUNTS] * len(part), key=part, n=total[part])

    turn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(ROUNDS)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", turn.alias("turn"), "text").mapInArrow(run, SCHEMA)


NULL = -(1 << 63)


@dataclass
class Block:
    """A block of texts, read: documents' ids, numbers of words and marks; the words by number; how many subwords each word has and all their ids; the words' places in the order of hashes."""

    doc_ids: np.ndarray
    each: np.ndarray
    marks: np.ndarray
    words: np.ndarray
    lens: np.ndarray
    flat: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        doc_ids = unpacked(row["a"], "<i8")
        m = len(doc_ids)
        each, marks = np.frombuffer(row["b"], "<u4", m).astype(np.int64), np.frombuffer(row["b"], np.uint8, m, 4 * m)
        lens = unpacked(row["d"], "<u4").astype(np.int64)
        return cls(doc_ids, each, marks, unpacked(row["c"], "<u4").astype(np.int64), lens, np.frombuffer(row["e"], "<u2", row["n"]).astype(np.int64), np.frombuffer(row["e"], "<u4", len(lens), 2 * row["n"]))


@dataclass
class Model:
    """Of each subword id: its class in context; the class within words and log10 of its share of that; the class as a first subword and log10 of its share
    of that. By counts, log10 of the probability of a class within words (the last column: of the word's end) after each, for each group of the
    word's first subword. The words that begin with each id. What share of a word's probability, given its first subword, is its own count's: the rest
    comes from neighbours. The network's parameters."""

    input: np.ndarray
    inner: np.ndarray
    share: np.ndarray
    output: np.ndarray
    first: np.ndarray
    after: np.ndarray
    begins: np.ndarray
    known: float
    net: dict[str, np.ndarray]
    end_id: int


def runs(counts: np.ndarray, n: int) -> np.ndarray:
    """n classes by falling count: the commonest alone, the rest in runs of equal number."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    alone = n * 3 // 4
    rest = max(1, -(-(len(counts) - alone) // (n - alone)))
    return np.where(rank < alone, rank, alone + (rank - alone) // rest)


def grouped(around: np.ndarray, weight: np.ndarray, steps: int = 20) -> np.ndarray:
    """The group of each id, by weighted k-means on the mean numbers of the texts around it. Ids of no weight are of group 0."""
    out = np.zeros(len(weight), np.int64)
    own = np.flatnonzero(weight > 0)
    if not len(own):
        return out
    x, w = around[own] / weight[own, None], weight[own]
    centre = [x[w.argmax()]]
    far = np.full(len(own), np.inf)
    for _ in range(GROUPS - 1):  # the next centre is heavy and far from those before
        far = np.minimum(far, ((x - centre[-1]) ** 2).sum(1))
        centre.append(x[(far * w).argmax()])
    centre = np.array(centre)
    for _ in range(steps):
        near = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        mass = np.bincount(near, w, minlength=GROUPS)
        for g in np.flatnonzero(mass):
            centre[g] = np.average(x[near == g], axis=0, weights=w[near == g])
    out[own] = near
    return out


def share(counts: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """log10 of each id's share of its class."""
    return np.log10((counts + 0.1) / np.bincount(kind, counts + 0.1)[kind])


def outer(firsts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Classes of first subwords: in each group EACH runs of near equal mass of the square root of counts."""
    out = np.zeros(len(firsts), np.int64)
    for g in range(GROUPS):
        own = np.flatnonzero(group == g)
        own = own[np.argsort(-firsts[own], kind="stable")]
        mass = np.cumsum(np.sqrt(firsts[own] + 0.01))
        if len(own):
            out[own] = g * EACH + np.minimum((mass - mass[0]) / mass[-1] * EACH, EACH - 1).astype(np.int64)
    return out


def start(firsts: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters before training: the network gives the shares of the classes (firsts: their counts) and adds almost nothing."""
    rng = np.random.default_rng(3)
    net = {k: (rng.standard_normal(s) * (0.3 if k in ("emb", "pos") else s[0] ** -0.5)).astype(np.float32) for k, s in SHAPES.items()}
    by = (firsts + 0.1).reshape(GROUPS, EACH)
    net["c"][:] = np.log(by.sum(1) / by.sum())
    net["d"][:] = np.log(by / by.sum(1, keepdims=True)).ravel()
    net["u"] *= 0.1
    net["w"] *= 0.1
    return net


def pair_keys(model: Model, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Where in Model.after each subword's step to the next, or to its word's end, stands."""
    kind = model.inner[flat]
    begin = np.cumsum(lens) - lens
    to = np.append(kind[1:], 0)
    to[begin + lens - 1] = INNER
    group = np.repeat(model.output[flat[begin]] // EACH, lens)
    return (group * INNER + kind) * (INNER + 1) + to


def after_counts(pairs: np.ndarray, counts: np.ndarray, prior: float = 5.0) -> np.ndarray:
    """log10 of the probability of each class, and of the end, after each, in each group. Counts of a group are smoothed by those of all, and these by how common classes are."""
    pairs = pairs.reshape(GROUPS, INNER, INNER + 1)
    mass = np.append(counts / counts.sum(), 1.0) / 2  # where nothing is known, a word ends as likely as not
    every = pairs.sum(0) + prior * np.maximum(mass, 1e-9)
    every /= every.sum(1, keepdims=True)
    p = pairs + prior * every
    return np.log10(p / p.sum(2, keepdims=True)).astype(np.float32).ravel()


class Places:
    """The places of some texts in windows, a row for each: `word` (rows x STRIDE) the number of the word at a place, -2 the text's begin, -1 none; `target`
    the word that comes next there, -2 the text's end, -1 none; `owner` the text of each row; `later` whether a row continues the one before.
    """

    def __init__(self, words_: np.ndarray, each: np.ndarray):
        n = each + 1
        rows = -(-n // STRIDE)
        begin = (np.cumsum(rows) - rows) * STRIDE
        total = int(rows.sum()) * STRIDE
        place = np.arange(len(words_)) + np.repeat(begin - (np.cumsum(each) - each), each)
        word, target = np.full(total, -1), np.full(total, -1)
        target[place], target[begin + each] = words_, -2
        # the last place of a text has its last word, and the end as its target
        word[place + 1], word[begin] = words_, -2
        self.word, self.target = word.reshape(-1, STRIDE), target.reshape(-1, STRIDE)
        self.owner = np.repeat(np.arange(len(each)), rows)
        self.later = np.zeros(len(self.owner), bool)
        self.later[1:] = self.owner[1:] == self.owner[:-1]

    def windows(self, a: int, b: int) -> np.ndarray:
        """Words of rows a to b - 1, with the BEFORE places that come before each row in its text."""
        before = np.full((b - a, BEFORE), -1)
        k = np.flatnonzero(self.later[a:b]) + a
        before[k - a] = self.word[k - 1][:, STRIDE - BEFORE :]
        return np.concatenate((before, self.word[a:b]), 1)


#: For the last STRIDE places of a window: which places they see (0) or don't (a large negative).
MASK = np.where(np.arange(SPAN)[None, :] <= np.arange(BEFORE, SPAN)[:, None], 0, -1e9).astype(np.float32)
ONES = np.ones((SPAN, 1), np.float32)


def attend(net: dict[str, np.ndarray], e: np.ndarray, none: np.ndarray) -> tuple:
    """Hidden vectors of the last STRIDE places of each window, and what backward() needs. e: vectors of places, without their position's; none: places of no word."""
    b = len(e)
    e = e + net["pos"]
    flat = e.reshape(-1, DIM)
    last = np.ascontiguousarray(e[:, BEFORE:]).reshape(-1, DIM)
    q = (last @ (net["q"] * DIM**-0.5)).reshape(b, STRIDE, DIM)
    k, v = (flat @ net["k"]).reshape(b, SPAN, DIM), (flat @ net["v"]).reshape(b, SPAN, DIM)
    a = np.matmul(q, k.transpose(0, 2, 1))
    if a.max() > 30:
        np.minimum(a, 30, out=a)  # exp() stays finite
    a += MASK
    if none[:, :BEFORE].any():
        a[:, :, :BEFORE] -= none[:, None, :BEFORE] * np.float32(1e9)
    np.exp(a, out=a)
    a /= np.matmul(a, ONES)
    z = np.matmul(a, v).reshape(-1, DIM)
    h = last + z @ net["o"]
    return h, (e, last, q, k, v, a, z)


def backward(net: dict[str, np.ndarray], kept: tuple, gh: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Gradients of the places' vectors and of the parameters of attend(), given that of the hidden vectors."""
    e, last, q, k, v, a, z = kept
    b, s = len(e), np.float32(DIM**-0.5)
    out = {"o": z.T @ gh}
    gz = (gh @ net["o"].T).reshape(b, STRIDE, DIM)
    ga = np.matmul(gz, v.transpose(0, 2, 1))
    gv = np.matmul(a.transpose(0, 2, 1), gz).reshape(-1, DIM)
    ga *= a
    ga -= a * np.matmul(ga, ONES)
    gq, gk = np.matmul(ga, k).reshape(-1, DIM), np.matmul(ga.transpose(0, 2, 1), q).reshape(-1, DIM)
    flat = e.reshape(-1, DIM)
    out |= {"q": s * (last.T @ gq), "k": flat.T @ gk, "v": flat.T @ gv}
    ge = (gk @ net["k"].T + gv @ net["v"].T).reshape(b, SPAN, DIM)
    ge[:, BEFORE:] += (gh + s * (gq @ net["q"].T)).reshape(b, STRIDE, DIM)
    out["pos"] = ge.sum(0)
    return ge, out


def choose(net: dict[str, np.ndarray], h: np.ndarray, at: np.ndarray, learn: bool = False) -> tuple:
    """Natural log-probability of one class a row: of its group, then of it in its group. With `learn` also the gradients of its negative sum: of h, and of the parameters."""
    group, n = at // EACH, np.arange(len(at))
    z = h @ net["u"]
    z += net["c"]
    p = exponents(z)
    total = p @ np.ones((GROUPS, 1), np.float32)
    out = z[n, group] - np.log(total[:, 0])
    # rows of one group stand together and meet its classes alone
    order = np.argsort(group.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    parts = [(slice(a, b), slice(g * EACH, (g + 1) * EACH)) for g, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]
    own, j = h[order], at[order] % EACH
    y = np.empty((len(at), EACH), h.dtype)
    for rows, cols in parts:
        np.matmul(own[rows], net["w"][:, cols], out=y[rows])
        y[rows] += net["d"][:, cols]
    r = exponents(y)
    mass = r @ np.ones((EACH, 1), np.float32)
    out[order] += y[n, j] - np.log(mass[:, 0])
    if not learn:
        return (out,)
    p /= total
    p[n, group] -= 1
    r /= mass
    r[n, j] -= 1
    back = np.empty_like(own)
    grads = {"u": h.T @ p, "c": p.sum(0, keepdims=True), "w": np.zeros_like(net["w"]), "d": np.zeros_like(net["d"])}
    for rows, cols in parts:
        np.matmul(r[rows], net["w"][:, cols].T, out=back[rows])
        grads["w"][:, cols], grads["d"][:, cols] = own[rows].T @ r[rows], np.ones((1, len(r[rows])), np.float32) @ r[rows]
    gh = p @ net["u"].T
    gh[order] += back
    return out, gh, grads


def exponents(z: np.ndarray) -> np.ndarray:
    """exp(z), finite: z is held within 30, in place, where it isn't already."""
    if z.size and (z.max() > 30 or z.min() < -30):
        np.clip(z, -30, 30, out=z)
    return np.exp(z)


def summed(key: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each key from 0 to n - 1."""
    at = key[:, None] * DIM + np.arange(DIM)
    return np.bincount(at.ravel(), rows.ravel(), minlength=n * DIM).reshape(n, DIM).astype(np.float32)


class Vectors:
    """Vectors of distinct words: the means of their subwords' vectors. The begin of a text has one of its own; no word has none."""

    def __init__(self, net: dict[str, np.ndarray], kinds: np.ndarray, begin: np.ndarray, lens: np.ndarray, numbers: np.ndarray):
        """kinds: classes of all words' subwords, in order; begin, lens: where a word's stand; numbers: the words wanted, with -2 and -1, in order."""
        self.numbers = numbers
        self.extra = int(np.searchsorted(numbers, 0))  # of -2 and -1
        own = numbers[self.extra :]
        self.lens = lens[own]
        at = np.arange(int(self.lens.sum())) + np.repeat(begin[own] - (np.cumsum(self.lens) - self.lens), self.lens)
        self.kinds = kinds[at]
        self.values = np.zeros((len(numbers), DIM), np.float32)
        if len(own):
            self.values[self.extra :] = np.add.reduceat(net["emb"][self.kinds], np.cumsum(self.lens) - self.lens, axis=0) / self.lens[:, None]
        if self.extra and numbers[0] == -2:
            self.values[0] = net["emb"][INPUTS]

    def gradient(self, which: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The gradient of `emb`, given those of words (which: their places in numbers)."""
        g = summed(which, g, len(self.numbers))
        rows = np.repeat(g[self.extra :] / self.lens[:, None].astype(np.float32), self.lens, axis=0)
        out = summed(self.kinds, rows, INPUTS + 1)
        if self.extra and self.numbers[0] == -2:
            out[INPUTS] += g[0]
        return out


def loss(model: Model, places: Places, a: int, b: int, kinds: np.ndarray, begin: np.ndarray, lens: np.ndarray, first: np.ndarray) -> tuple:
    """Of rows a to b - 1: the mean negative log-probability of the next words' classes, its gradients, and the number of words."""
    window = places.windows(a, b)
    numbers, which = np.unique(window, return_inverse=True)
    which = which.reshape(window.shape)
    vectors = Vectors(model.net, kinds, begin, lens, numbers)
    h, kept = attend(model.net, vectors.values[which], window == -1)
    target = places.target[a:b].ravel()
    ok = np.flatnonzero(target != -1)
    at = model.output[np.where(target[ok] < 0, model.end_id, first[target[ok]])]
    logp, gh, grads = choose(model.net, h[ok], at, learn=True)
    n = len(ok)
    g = np.zeros_like(h)
    g[ok] = gh / n
    ge, more = backward(model.net, kept, g)
    grads = {k: x / n for k, x in grads.items()} | more
    ge[window == -1] = 0
    grads["emb"] = vectors.gradient(which.ravel(), ge.reshape(-1, DIM))
    return -float(logp.mean()), grads, n


def train(model: Model, block: Block, turn: int, state: dict, rate: float = 0.1) -> int:
    """Adagrad steps on all windows of the block's training rows of a round, in place; the number of words learnt from."""
    mine = np.flatnonzero(block.marks == turn)
    if not len(mine):
        return 0
    stop = np.cumsum(block.each)
    each = block.each[mine]
    at = np.arange(int(each.sum())) + np.repeat((stop - block.each)[mine] - (np.cumsum(each) - each), each)
    places = Places(block.words[at], each)
    begin = np.cumsum(block.lens) - block.lens
    kinds, first = model.input[block.flat], block.flat[begin]
    chunks_, learnt = range(0, len(places.owner), BATCH), 0
    for k in np.random.default_rng(turn).permutation(len(chunks_)):
        a, end = chunks_[k], min(chunks_[k] + BATCH, len(places.owner))
        while a < end:
            b = min(end, a + min(BATCH, FEW << state["steps"] // SOON))
            _, grads, n = loss(model, places, a, b, kinds, begin, block.lens, first)
            a = b
            learnt += n
            state["steps"] = min(state["steps"] + 1, 32 * SOON)
            for name, g in grads.items():
                state[name] += g * g
                model.net[name] -= (rate * g / np.sqrt(state[name])).astype(np.float32)
    return learnt


def tails(model: Model, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """log10 of the probability of each word's subwords after its first, and of its end there."""
    if not len(lens):
        return np.zeros(0)
    begin = np.cumsum(lens) - lens
    into = model.after[pair_keys(model, lens, flat)].astype(float)
    own = model.share[flat]
    own[begin] = 0
    return np.add.reduceat(into + own, begin)


def score_block(model: Model, block: Block, count: np.ndarray, per_step: int = 256) -> np.ndarray:
    """log10 probability of each text with its end, to four digits. count: how often each word occurs in training rows."""
    out = np.zeros(len(block.each))
    if not len(out):
        return out
    places = Places(block.words, block.each)
    begin = np.cumsum(block.lens) - block.lens
    own = block.flat[begin]
    first = np.append(own, model.end_id)  # the last stands for the end of a text
    of_first = np.divide(count, model.begins[own], out=np.zeros(len(own)), where=model.begins[own] > 0)
    rest = np.append(np.log10(model.known * of_first + (1 - model.known) * 10.0 ** tails(model, block.lens, block.flat)), 0.0)
    total = len(block.lens)
    numbers = np.concatenate(([-2, -1], np.arange(total)))
    vectors = Vectors(model.net, model.input[block.flat], begin, block.lens, numbers).values
    for a in range(0, len(places.owner), per_step):
        b = min(a + per_step, len(places.owner))
        window = places.windows(a, b)
        h, _ = attend(model.net, vectors[window + 2], window == -1)
        target = places.target[a:b].ravel()
        ok = np.flatnonzero(target != -1)
        word = np.where(target[ok] < 0, total, target[ok])
        id_ = first[word]
        (logp,) = choose(model.net, h[ok], model.output[id_])
        own = np.repeat(places.owner[a:b], STRIDE)[ok]
        out += np.bincount(own, logp * np.log10(np.e) + model.first[id_] + rest[word], minlength=len(out))
    return np.round(out, 4)


def _learner(model: Model, turn: int):
    """Trains a copy of the network on a task's blocks; its parameters, times the words learnt from, and their number."""

    def learn(batches):
        own = replace(model, after=model.after[:0], net={k: x.copy() for k, x in model.net.items()})
        n, state = 0, {"steps": 0} | {k: np.full(s, 1e-6, np.float32) for k, s in SHAPES.items()}
        for batch in batches:
            for i in range(len(batch)):
                n += train(own, Block.of({c: batch.column(c)[i].as_py() for c in FIELDS}), turn, state)
        if n:
            values = np.concatenate([own.net[k].ravel() for k in SHAPES]).astype(np.float64) * n
            yield pa.record_batch({"i": pa.array(np.arange(len(values) + 1), pa.int32()), "x": pa.array(np.append(values, n))})

    return learn


def _total(key, table):
    """Of one part of the words: each block's words' counts in all blocks (a), and in its first row the part's tokens and distinct words."""
    hashes = [np.frombuffer(x, "<u8") for x in table.column("a").to_pylist()]
    n = np.concatenate([unpacked(x, "<u4") for x in table.column("b").to_pylist()])
    known, own = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(own, n, minlength=len(known)).astype("<i8")
    each, ends = total[own], np.cumsum([0, *map(len, hashes)])
    m = len(hashes)
    first = np.zeros(m, np.int64)
    tokens, distinct = first.copy(), first.copy()
    tokens[0], distinct[0] = total.sum(), (total > 0).sum()
    return pa.table({"block": table.column("block"), "a": pa.array([packed(each[i:j]) for i, j in zip(ends, ends[1:], strict=False)], pa.binary()), "key": table.column("key"), "tokens": pa.array(tokens), "words": pa.array(distinct)})


def score(docs: DataFrame, held_out: Column, tokenizer: str, vocabulary: int = 50_257, end_id: int = 50_256) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Tokens are words (runs of other characters than ASCII white space, A-Z lowered) and one end. Rows that are held out teach nothing. A null text is an
    empty one and has the end alone. tokenizer: a file of ranks (tiktoken), with `end_id` free. Equal texts get equal scores. Words are told apart by 64-bit hashes. With no training rows every count is 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text").withColumn("held_out", held_out)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a part's words are counted in one task: about a million and a half from all blocks
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(size, 1 << 50) // 20_000_000)
    path = shared_dir(spark)
    blocks(base.select("doc_id", "held_out", "text"), tokenizer, parts).write.partitionBy("kind").parquet(path)
    made = spark.read.schema(SCHEMA).parquet(path)
    rows = made.where(F.col("kind") == TEXTS).select("block", "n", "a", "b", "c", "d", "e")
    counted = stored(made.where(F.col("kind") == PARTS).select("part", "block", "a", "b", "key").groupBy("part").applyInArrow(_total, "block long, a binary, key long, tokens long, words long"))
    ends = base.where("not held_out").count()
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n_train, distinct = total[0] + ends, total[1] + (ends > 0)
    base_log = float(np.log10(n_train + 0.1 * (distinct + 1)))
    model = _counts_model(made.where(F.col("kind") == COUNTS).select("key", "n"), rows, vocabulary, end_id, ends)
    model.known = total[0] / max(1, total[0] + total[1])  # as words go, one in so many is new
    for turn in range(ROUNDS):
        new = rows.select(*FIELDS).mapInArrow(_learner(model, turn), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # a row per parameter
        x = new.column("x").to_numpy()[np.argsort(new.column("i").to_numpy())]
        if len(x):
            x, at = x[:-1] / x[-1], 0
            for k, s in SHAPES.items():
                model.net[k] = x[at : at + s[0] * s[1]].reshape(s).astype(np.float32)
                at += s[0] * s[1]

    def final(key, left, right):
        block = Block.of({c: left.column(c)[0].as_py() for c in FIELDS})
        c = np.zeros(len(block.lens), np.int64)
        for value, place in zip(right.column("a").to_pylist(), right.column("key").to_pylist(), strict=True):
            value = unpacked(value, "<i8")
            c[place : place + len(value)] = value
        c = c[block.order]
        doc = np.repeat(np.arange(len(block.each)), block.each)
        known = np.bincount(doc, (c > 0)[block.words], minlength=len(block.each)).astype(np.int64)
        sums = np.bincount(doc, (np.log10(c + 0.1) - base_log)[block.words], minlength=len(block.each))
        return pa.table({"doc_id": pa.array(block.doc_ids, mask=block.doc_ids == NULL), "held_out": pa.array(block.marks == HELD), "n_tokens": pa.array(block.each + 1), "n_known": pa.array(known + (ends > 0)), "base_score": pa.array(sums + np.log10(ends + 0.1) - base_log), "score": pa.array(score_block(model, block, c))})

    out = rows.groupBy("block").cogroup(counted.select("block", "a", "key").groupBy("block")).applyInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")


FIELDS = ("n", "a", "b", "c", "d", "e")


def _counts_model(counts: DataFrame, rows: DataFrame, vocabulary: int, end_id: int, ends: int) -> Model:
    """The model before training: classes of subwords and all that counts alone give. counts: COUNTS; rows: TEXTS."""
    got = counts.groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # so many for each subword id at most
    total = np.zeros(65536 * (2 + SIGNS))
    total[got.column("key").to_numpy()] = got.column("n").to_numpy()
    inside, firsts, around = total[:65536][:vocabulary], total[65536:131072][:vocabulary], total[131072:].reshape(65536, SIGNS)[:vocabulary] / 1e6
    group = grouped(around, firsts)
    begins = firsts.copy()
    firsts[end_id] += ends
    output, inner = outer(firsts, group), runs(inside, INNER)
    model = Model(runs(inside, INPUTS), inner, share(inside, inner), output, share(firsts, output), np.zeros(0, np.float32), begins, 0.0, start(np.bincount(output, firsts, minlength=OUTPUTS)), end_id)

    def pairs(batches):
        total = np.zeros(GROUPS * INNER * (INNER + 1), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                block = Block.of({c: batch.column(c)[i].as_py() for c in FIELDS})
                if not len(block.lens):
                    continue
                n = np.bincount(block.words[np.repeat(block.marks != HELD, block.each)], minlength=len(block.lens))
                key, own = np.unique(pair_keys(model, block.lens, block.flat), return_inverse=True)
                total[key] += np.bincount(own, np.repeat(n, block.lens)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch({"i": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    got = rows.select(*FIELDS).mapInArrow(pairs, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # groups by classes by classes at most
    found = np.zeros(GROUPS * INNER * (INNER + 1))
    found[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return replace(model, after=after_counts(found, np.bincount(inner, inside + 0.1, minlength=INNER)))
