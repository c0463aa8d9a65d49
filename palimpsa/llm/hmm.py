"""Hidden Markov language model.

Words are lower-cased (A-Z), and one end follows every text. Latent states emit
symbols: frequent words have one each, all other words share a symbol by their
last two bytes. Given its symbol, a rare word has its smoothed share of the
symbol's training tokens; this factor does not depend on the state. So

    P(text) = forward(symbols) * product of P(word | symbol) over the rare words,

which sums to one over all texts. Training is Baum-Welch: each round, tasks run
forward-backward over whole training texts and return expected counts, which Spark
sums across partitions. Long texts are computed in spans side by side: the exact
forward and backward vectors at their edges come from each span's transfer matrix.
The first round is stepwise: all training texts are dealt into parts by a hash, and
the model is maximised after each part, so that it learns from all of them and moves
from its symmetric start as often as there are parts. The other rounds sum all parts
before a step. Scores use the scaled forward recursion over whole texts, which is
the exact likelihood.

Word counts are a table, never held by one process; only the HEAD most frequent
words are. The rare words of a text meet the table in a join.

Defined results: null and empty texts are the end alone; rows with a null id
are neither held out nor trained on; repeated rows are counted and scored each;
an empty table gives an empty result; without training texts every word is
unknown. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.recovery import cut
from .common import blocks, claim, held_by, id_and_bytes, training_fold

FOLDS = 5
STATES = 8
#: Words with a symbol of their own; symbols that the others share.
OWN, SHARED = 3000, 256
#: Most frequent words whose counts every worker holds.
HEAD = 60_000
#: Full rounds of Baum-Welch, and parts of the stepwise round before them; a step forgets by its number to this power.
ROUNDS, PARTS, FORGETS = 3, 12, 0.7
#: Steps of a text that are computed one after the other in training; its spans run side by side.
SPAN = 512
END = b""


def shared_symbol(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHARED


class Vocabulary(dict):
    """Number of a word: its rank if it is a head word, else len(head) + its shared symbol."""

    LIMIT = 400_000

    def __init__(self, head: list[bytes], own: int):
        super().__init__({w: i for i, w in enumerate(head)})
        self.head = len(head)
        self.own = min(own, len(head))
        ids = np.arange(self.head + SHARED)
        symbols = np.where(ids < self.own, ids, 0)
        symbols[self.own : self.head] = [self.own + shared_symbol(w) for w in head[self.own :]]
        symbols[self.head :] = self.own + np.arange(SHARED)
        self.symbols = symbols.astype(np.int32)

    def __missing__(self, word: bytes) -> int:
        found = self.head + shared_symbol(word)
        if len(self) < self.LIMIT:
            self[word] = found
        return found

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.array([*map(self.__getitem__, words), self[END]], np.int32)


@dataclass
class Model:
    start: np.ndarray  # (states,)
    moves: np.ndarray  # (states, states)
    emits: np.ndarray  # (symbols, states)


def fresh_model(counts: np.ndarray, states: int = STATES) -> Model:
    """States that keep to themselves, with disturbed unigram emissions."""
    rng = np.random.default_rng(7)
    emits = (counts[:, None] + 0.5) * rng.gamma(1.0, 1.0, (len(counts), states))
    moves = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.95)
    return Model(np.full(states, 1 / states), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of sequences by falling length, how many reach each step, and where the step begins."""
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max()) if len(lengths) else 0
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), side="right")
    return order, active, np.concatenate(([0], np.cumsum(active)))


def _by_step(seqs: list[np.ndarray], order: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Symbols of all sequences, step by step."""
    lengths = np.array([len(seqs[i]) for i in order])
    flat = np.concatenate([seqs[i] for i in order])
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.empty(len(flat), flat.dtype)
    out[offsets[pos] + np.repeat(np.arange(len(order)), lengths)] = flat
    return out


def forward_log10(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of every symbol sequence, by scaled forward recursion."""
    lengths = np.array([len(s) for s in seqs])
    order, active, offsets = _layout(lengths)
    obs = _by_step(seqs, order, offsets)
    total = np.zeros(len(seqs))
    a = np.repeat(model.start[None, :], len(seqs), axis=0)
    for t, n in enumerate(active.tolist()):
        a = a[:n] @ model.moves if t else a[:n]
        a = a * model.emits[obs[offsets[t] : offsets[t] + n]]
        scale = a.sum(axis=1)
        total[:n] += np.log10(scale)
        a /= scale[:, None]
    out = np.empty(len(seqs))
    out[order] = total
    return out


def transfer_matrices(model: Model, spans: list[np.ndarray]) -> np.ndarray:
    """For each span, up to a factor, P(its symbols, last state | first state): (spans, states, states)."""
    order, active, offsets = _layout(np.array([len(s) for s in spans]))
    obs = _by_step(spans, order, offsets)
    kind, k = np.float32, len(model.start)
    e = (model.emits / model.emits.max(axis=1, keepdims=True)).astype(kind)[obs]
    moves = model.moves.astype(kind)
    held = np.zeros((len(spans), k, k), kind)
    held[:, np.arange(k), np.arange(k)] = e[: len(spans)]
    for t, n in enumerate(active.tolist()):
        if t:
            part = (held[:n].reshape(-1, k) @ moves).reshape(n, k, k)
            part *= e[offsets[t] : offsets[t] + n, None, :]
            if t % 4 == 0:
                part /= np.maximum(part.max(axis=(1, 2), keepdims=True), 1e-30)
            held[:n] = part
    out = np.empty((len(spans), k, k))
    out[order] = held
    return out


def span_edges(model: Model, spans: list[np.ndarray], at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State distributions before each span's first symbol and after its last, and the backward vector there.

    ``at`` is a span's place in its text and ``of`` the number of spans of that
    text; the spans of a text follow one another.
    """
    n, k = len(spans), len(model.start)
    before, after, back = np.tile(model.start, (n, 1)), np.zeros((n, k)), np.ones((n, k))
    many = np.flatnonzero(of > 1)
    if not len(many):
        return before, after, back
    matrix = np.zeros((n, k, k))
    matrix[many] = transfer_matrices(model, [spans[i] for i in many])
    unit = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300)
    for place in range(int(of.max())):
        own = many[at[many] == place]
        after[own] = unit(np.einsum("ni,nij->nj", before[own], matrix[own]))
        on = own[at[own] + 1 < of[own]]
        before[on + 1] = after[on] @ model.moves
    for place in range(int(of.max()) - 2, -1, -1):
        own = many[(at[many] == place) & (of[many] > place + 1)]
        back[own] = unit(np.einsum("nij,nj->ni", matrix[own + 1], back[own + 1]) @ model.moves.T)
    inner = many[at[many] + 1 < of[many]]
    back[inner] /= (after[inner] * back[inner]).sum(axis=1, keepdims=True)  # so that forward times backward sums to one
    return before, after, back


def expected_counts(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions over whole sequences, and the log10 likelihood."""
    spans = [x for s in seqs for x in _spans(s)]
    of = np.repeat([-(-len(s) // SPAN) for s in seqs], [-(-len(s) // SPAN) for s in seqs])
    at = np.concatenate([np.arange(-(-len(s) // SPAN)) for s in seqs]) if seqs else np.zeros(0, int)
    before, after, back = span_edges(model, spans, at, of)
    lengths = np.array([len(s) for s in spans])
    order, active, offsets = _layout(lengths)
    obs = _by_step(spans, order, offsets)
    n_states = len(model.start)
    kind = np.float32
    moves, emits = model.moves.astype(kind), model.emits.astype(kind)
    e = emits[obs]
    alpha = np.empty((len(obs), n_states), kind)
    a = before[order].astype(kind)
    scales = np.empty(len(obs), kind)
    for t, n in enumerate(active.tolist()):
        lo = offsets[t]
        a = a[:n] @ moves if t else a[:n]
        a = a * e[lo : lo + n]
        scale = a.sum(axis=1)
        a /= scale[:, None]
        scales[lo : lo + n] = scale
        alpha[lo : lo + n] = a
    total = float(np.log10(scales.astype(np.float64)).sum())
    xi = np.zeros((n_states, n_states))
    ends = back[order].astype(kind)
    b = np.ones((0, n_states), kind)
    for t in range(len(active) - 1, -1, -1):
        lo, n = offsets[t], int(active[t])
        if len(b) < n:
            b = np.concatenate([b, ends[len(b) : n]])
        w = b * e[lo : lo + n] / scales[lo : lo + n, None]
        if t:
            xi += alpha[offsets[t - 1] : offsets[t - 1] + n].T @ w
        else:  # moves from the span before
            xi += np.where(at[order] > 0, after[np.maximum(order - 1, 0)].T, 0) @ w
        here = alpha[lo : lo + n]
        here *= b
        b = w @ moves.T
    gamma = alpha / np.maximum(alpha.sum(axis=1, keepdims=True), 1e-30)
    firsts = at[order] == 0
    starts = gamma[: int(active[0])][firsts].sum(axis=0, dtype=np.float64) if len(active) else np.zeros(n_states)
    out = np.stack([np.bincount(obs, gamma[:, k], len(model.emits)) for k in range(n_states)], axis=1)
    return starts, xi * moves, out, total


def maximise(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, unigram: np.ndarray) -> Model:
    """The model of expected counts; a little of the unigram keeps every symbol possible."""
    prior = (unigram + 0.5) / (unigram + 0.5).sum()
    emits = emits + 20.0 * prior[:, None]
    moves = moves + 0.1
    starts = starts + 0.1
    return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def _spans(seq: np.ndarray) -> list[np.ndarray]:
    return [seq[i : i + SPAN] for i in range(0, len(seq), SPAN)]


def word_counts(train: DataFrame) -> DataFrame:
    """``word binary, c`` over all texts; the end is the empty word."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for _, texts in blocks(batches):
            for t in texts:
                held.update(t.lower().split())
            held[END] += len(texts)
            if len(held) > 300_000:
                yield _counts_batch(held)
                held = Counter()
        if held:
            yield _counts_batch(held)

    return train.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counts_batch(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"]
    )


def train_model(train: DataFrame, vocabulary: list[bytes], symbol_counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all texts of ``train``; their symbols are kept in the shared folder for the rounds."""
    model = fresh_model(symbol_counts)
    spark = train.sparkSession
    shared_head = spark.sparkContext.broadcast((vocabulary, OWN))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(shared_head)
        for ids, texts in blocks(batches):
            coded = [own.symbols[own.numbers(t.lower().split())].astype("<u2").tobytes() for t in texts]
            marks = [xxhash.xxh64_intdigest(t) >> 34 for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(coded, pa.binary())], names=["mark", "symbols"])

    coded = cut(train.mapInArrow(encode, "mark long, symbols binary"))
    n_states, n_symbols = model.emits.shape[1], model.emits.shape[0]
    names = [f"s{k}" for k in range(n_states)]

    def summed(part: DataFrame, current: Model) -> np.ndarray:
        """Expected counts over texts: symbols, moves, starts and the likelihood, a row each."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("hmm")
            sums = None
            for _, texts in blocks(batches, 1 << 20):
                more = expected_counts(current, [np.frombuffer(t, "<u2") for t in texts])
                sums = more if sums is None else tuple(x + y for x, y in zip(sums, more, strict=True))
            if sums is not None:
                rows = np.concatenate([sums[2], sums[1], sums[0][None, :], np.full((1, n_states), sums[3])])
                used = np.flatnonzero(rows.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(rows[used, k]) for k in range(n_states)]], names=["row", *names])

        counts = part.mapInArrow(run, "row long, " + ", ".join(f"{n} double" for n in names))
        out = np.zeros((n_symbols + n_states + 2, n_states))
        for r in counts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).collect():  # symbols + states + 2 rows
            out[r["row"]] = [r[n] for n in names]
        return out

    step = lambda x: maximise(x[-2], x[n_symbols : n_symbols + n_states], x[:n_symbols], symbol_counts)
    n_tokens, held = symbol_counts.sum(), None
    for i in range(PARTS):
        part = summed(coded.filter(F.col("mark") % PARTS == i), model)
        if seen := part[:n_symbols].sum():
            part *= n_tokens / seen  # as if all texts were like those of the part
            share = 1.0 if held is None else (i + 1) ** -FORGETS
            held = part if held is None else (1 - share) * held + share * part
            model = step(held)
    for _ in range(rounds):
        model = step(summed(coded, model))
    return model


_VOCABULARIES: dict[int, tuple] = {}
held_by("hmm", _VOCABULARIES.clear)


def _vocabulary(shared) -> Vocabulary:
    """The worker's vocabulary for a broadcast head."""
    claim("hmm")
    key = id(shared.value)  # one object per broadcast and process, kept by the entry below
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = (shared.value, Vocabulary(*shared.value))
    return _VOCABULARIES[key][1]


def frequent(counts: DataFrame, most: int | None = None) -> DataFrame:
    """The words with the largest counts, HEAD at most: those above the last size class that fits.

    A histogram by size class (16 to a doubling) finds the bound, so no task or
    process sees more than the words themselves.
    """
    level = F.floor(F.log2(F.col("c").cast("double")) * 16)
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    held, least = 0, 1 << 20
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > (HEAD if most is None else most):
            break
        least = at
    return counts.filter(level >= least)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    rows = id_and_bytes(docs, id_col, text_col)
    train = rows.filter(F.coalesce(training_fold("doc_id", FOLDS), F.lit(False)))
    counts = cut(word_counts(train))
    symbol = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(SHARED)).cast("int")
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, v_train = totals["n"] or 0, totals["v"]
    top = sorted(frequent(counts).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    head = [bytes(r["word"]) for r in top]
    head_counts = np.array([r["c"] for r in top], np.int64)
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c").alias("n")).first()["n"] or 0
    if END in head:
        at = head.index(END)
        head, head_counts = head[:at] + head[at + 1 :], np.delete(head_counts, at)
    # The end always has a symbol of its own, whatever its size class.
    head, head_counts = [END, *head], np.concatenate([[ends], head_counts]).astype(np.int64)
    voc = Vocabulary(head, OWN)
    shared_rows = counts.groupBy(symbol.alias("s")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tokens, kinds = np.zeros(SHARED), np.zeros(SHARED)
    for r in shared_rows:
        tokens[r["s"]], kinds[r["s"]] = r["n"], r["v"]
    for w, c in zip(head[: voc.own], head_counts[: voc.own].tolist(), strict=True):
        if c:
            tokens[shared_symbol(w)] -= c
            kinds[shared_symbol(w)] -= 1
    symbol_counts = np.concatenate([head_counts[: voc.own], tokens]).astype(float)
    model = train_model(train, head, symbol_counts)
    mass = np.log10(tokens + 0.5 * (kinds + 1))  # of the words that share a symbol
    base_mass = float(np.log10(n_train + 0.5 * (v_train + 1)))
    log_head = np.concatenate([np.log10(head_counts + 0.5), np.zeros(SHARED)])
    shared_head = spark.sparkContext.broadcast((head, OWN))

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(shared_head)
        known = own.head
        is_head = set(shared_head.value[0])
        # Long texts leave few sequences for the last steps; larger blocks share that.
        for ids, texts in blocks(batches, 8 << 20):
            words = [t.lower().split() for t in texts]
            numbers = [own.numbers(w) for w in words]
            symbols = [own.symbols[x] for x in numbers]
            likelihood = forward_log10(model, symbols)
            sums, shared, n_known, rare = [], [], [], []
            for w, x, s in zip(words, numbers, symbols, strict=True):
                logs = log_head[x]
                sums.append(float(logs.sum()))
                tail = s >= own.own
                shared.append(float(logs[tail].sum() - mass[s[tail] - own.own].sum()))
                in_head = x < known
                n_known.append(int((in_head & (head_counts[np.minimum(x, known - 1)] > 0)).sum()))
                rare.append(Counter([] if in_head.all() else [v for v in w if v not in is_head]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(x) for x in numbers], pa.int64()),
                    pa.array(n_known, pa.int64()),
                    pa.array(sums),
                    pa.array(likelihood + np.array(shared)),
                    pa.array([list(r.keys()) for r in rare], pa.list_(pa.binary())),
                    pa.array([list(r.values()) for r in rare], pa.list_(pa.int32())),
                ],
                names=["doc_id", "n_tokens", "head_known", "head_sum", "partial", "rare", "times"],
            )

    schema = "doc_id long, n_tokens long, head_known long, head_sum double, partial double, rare array<binary>, times array<int>"
    # Row numbers are fixed by writing them, with what each text still needs from the table of counts.
    placed = cut(rows.mapInArrow(local, schema).withColumn("row", F.monotonically_increasing_id()))
    needs = placed.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
    found = (
        needs.join(counts, needs["rare"] == counts["word"], "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_sum"),
            F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    out = placed.drop("rare", "times").join(found, "row", "left")
    rest = F.coalesce("rare_sum", F.lit(0.0))
    return out.select(
        "doc_id",
        F.coalesce(~training_fold("doc_id", FOLDS), F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("head_sum") + rest - F.col("n_tokens") * F.lit(base_mass)).alias("base_score"),
        (F.col("partial") + rest).alias("score"),
    )
