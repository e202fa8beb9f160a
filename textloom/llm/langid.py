"""Language identification of words in code-switched text by a linear-chain CRF.

Each word (run of letters, marks and apostrophes) is described by affixes, character
n-grams and its own form (lexicon), hashed into one weight table; learned transition
weights join the labels of neighbouring words. The model is fitted by gradient ascent
on the conditional likelihood, and forward-backward gives each word's label
probabilities. A document's language is the label with the largest sum of them.

Forward-backward runs on all documents of a slice at once: chains are cut into
blocks, the transfer matrix of every block is multiplied up in parallel, block
borders are chained, and the blocks are filled in. That is exact for any length.

The fit reads whole texts and sums the gradient in partitions; only that sum, whose
size is fixed, meets at the driver in each round. Labelled documents are of one language
each, so pieces of PIECE words of several documents are strung together, in the order
of a hash: transitions are learned from chains with switches.

Fit bound: at most FIT_DOCS labelled texts (smallest hash of the id, a documented
parameter, counted after equal rows are merged); of these, every word counts.

Defined cases: null text or a text without a letter: `und` with score 0; ties go to
the first language in sorted order; null langs and null texts are not learned from; a
null id is a training row; without any labelled document every text is `und`; with one
language every text with a letter has it; equal rows are learned from once and scored
row by row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the texts used for fitting, words of a piece, words of a chain, partitions of the fit, rounds.
FIT_DOCS, PIECE, CHAIN, PARTS, ROUNDS, RATE, PENALTY = 1_000, 32, 1 << 16, 6, 25, 0.5, 1e-6
#: Slots of the weight table; feature kinds of a word.
SLOTS, WIDTH, BLOCK = 1 << 17, 24, 32
#: Entries of the emission cache of one Python worker.
CACHE = 200_000

_WORDS = regex.compile(r"[\p{L}\p{M}'’]*\p{L}[\p{L}\p{M}'’]*").findall
_ASCII = regex.compile(r"[A-Za-z']*[A-Za-z][A-Za-z']*").findall


def words_of(text: str | None) -> list[str]:
    """Lower-case words that hold a letter."""
    return (_ASCII(text) if text.isascii() else _WORDS(text)) if text else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature slots of each word, (n, k), and a mask of those that exist:
    whole form, prefixes and suffixes of 1 to 3, bigrams and trigrams."""
    n = len(words)
    text = np.zeros((n, WIDTH), np.uint64)
    lower = [w.lower() for w in words]
    sizes = np.fromiter(map(len, lower), np.int64, n)
    codes = np.frombuffer("".join(w if len(w) <= WIDTH else w[: WIDTH // 2] + w[-WIDTH // 2 :] for w in lower).encode("utf-32-le"), np.uint32)
    size = np.minimum(sizes, WIDTH)
    text[np.arange(WIDTH)[None, :] < size[:, None]] = codes
    p = np.uint64(0x100000001B3)
    whole = np.fromiter(map(hash_word, lower), np.uint64, n)
    out, has = [whole * np.uint64(31) + np.uint64(1)], [np.ones(n, bool)]
    at = np.arange(n)
    for k in (1, 2, 3):
        pre = np.zeros(n, np.uint64)
        suf = np.zeros(n, np.uint64)
        for j in range(k):
            pre = pre * p + text[:, j] + np.uint64(1)
            suf = suf * p + text[at, np.maximum(size - k + j, 0)] + np.uint64(1)
        out += [pre * np.uint64(31) + np.uint64(10 + k), suf * np.uint64(31) + np.uint64(20 + k)]
        has += [size >= k, size >= k]
    for k in (2, 3):
        gram = np.zeros((n, WIDTH - k + 1), np.uint64)
        for j in range(k):
            gram = gram * p + text[:, j : WIDTH - k + 1 + j] + np.uint64(1)
        out += list((gram * np.uint64(31) + np.uint64(30 + k)).T)
        has += list((np.arange(WIDTH - k + 1)[None, :] + k <= size[:, None]).T)
    return (common.mix64(np.stack(out, 1)) % np.uint64(SLOTS)).astype(np.int32), np.stack(has, 1)


def hash_word(word: str) -> int:
    """FNV-1a of a word, stable between processes."""
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def marginals(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray, block: int = BLOCK, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities (words, labels) of chains that lie one after another.

    emit: (words, labels) scores; trans: (labels, labels); lengths: words of a chain.
    The expected number of each pair of neighbouring labels is added to `pairs`.
    """
    total, k = emit.shape
    if not total:
        return emit.copy()
    lengths = lengths[lengths > 0]
    n_blocks = -(-lengths // block)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)[:-1]])
    starts = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), n_blocks) + (np.arange(n_blocks.sum()) - np.repeat(first_block, n_blocks)) * block
    sizes = np.minimum(np.repeat(np.cumsum(lengths), n_blocks) - starts, block)
    m = len(starts)
    pos = starts[:, None] + np.minimum(np.arange(block)[None, :], sizes[:, None] - 1)
    weight = np.exp(emit - emit.max(1, keepdims=True))[pos]  # (m, block, k)
    inside = np.arange(block)[None, :] < sizes[:, None]
    step = np.exp(trans - trans.max())

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.reshape(len(x), -1).max(1).reshape((-1,) + (1,) * (x.ndim - 1))

    # transfer matrix of each block: from the label before it to the label of its last word
    matrix = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for j in range(block):
        live = inside[:, j]
        if not live.any():
            break
        matrix[live] = scaled(matrix[live] @ step * weight[live, j][:, None, :])
    is_first = np.zeros(m, bool)
    is_first[first_block] = True
    # chain the borders: alpha before each block, beta after each block
    before, after = np.zeros((m, k)), np.ones((m, k))
    chains = np.arange(len(lengths))
    row = np.zeros((len(lengths), k))
    for j in range(int(n_blocks.max())):
        chains = chains[n_blocks[chains] > j]
        b = first_block[chains] + j
        before[b] = row[chains]
        nxt = np.einsum("ni,nij->nj", row[chains], matrix[b]) if j else _first_alpha(weight[b], inside[b], step)
        row[chains] = scaled(nxt)
    chains = np.arange(len(lengths))
    row = np.ones((len(lengths), k))
    for j in range(int(n_blocks.max())):
        chains = chains[n_blocks[chains] > j]
        b = first_block[chains] + n_blocks[chains] - 1 - j
        after[b] = row[chains]
        row[chains] = scaled(np.einsum("nij,nj->ni", matrix[b], row[chains]))
    # fill in
    alpha = np.zeros((m, block, k))
    current = before
    for j in range(block):
        moved = current @ step
        if j == 0:
            moved[is_first] = 1.0
        current = scaled(moved * weight[:, j])
        alpha[:, j] = current
    out = np.zeros((m, block, k))
    current = after
    for j in range(block - 1, -1, -1):
        live = inside[:, j]
        out[:, j] = alpha[:, j] * current
        if pairs is not None:
            at = live if j else live & ~is_first
            both = (alpha[at, j - 1] if j else before[at])[:, :, None] * step * (weight[at, j] * current[at])[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        current = np.where(live[:, None], scaled((weight[:, j] * current) @ step.T), current)
    flat = out[inside]
    return flat / flat.sum(1, keepdims=True)


def _first_alpha(weight: np.ndarray, inside: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Forward row at the end of the first block of a chain, which has no label before."""
    row = weight[:, 0].copy()
    for j in range(1, weight.shape[1]):
        live = inside[:, j]
        if not live.any():
            break
        row[live] = row[live] @ step * weight[live, j]
        row /= row.max(1, keepdims=True)
    return row


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray) -> None:
        self.langs, self.weights, self.trans = langs, weights, trans

    def emissions(self, words: list[str]) -> np.ndarray:
        slots, has = features(words)
        return np.einsum("nfk,nf->nk", self.weights[slots], has.astype(np.float32)) / np.sqrt(has.sum(1, keepdims=True))


class Chain:
    """One chain of labelled words: its vocabulary's features, and words by vocabulary."""

    def __init__(self, words: list[str], tags: np.ndarray) -> None:
        vocabulary = sorted(set(words))
        at = dict(zip(vocabulary, range(len(vocabulary))))
        self.index, self.tags = np.fromiter(map(at.__getitem__, words), np.int32, len(words)), tags.astype(np.int8)
        slots, has = features(vocabulary)
        self.counts, self.slots = has.sum(1).astype(np.int32), slots[has]

    def pack(self) -> list[bytes]:
        return [self.index.tobytes(), self.tags.tobytes(), self.counts.tobytes(), self.slots.tobytes()]

    @classmethod
    def unpack(cls, cells: list[bytes]) -> Chain:
        self = cls.__new__(cls)
        self.index, self.tags, self.counts, self.slots = (np.frombuffer(c, kind) for c, kind in zip(cells, (np.int32, np.int8, np.int32, np.int32)))
        return self

    def gradient(self, weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log-likelihood of the labels by weights and transitions."""
        k, scale = trans.shape[0], 1 / np.sqrt(self.counts)[:, None]
        starts = np.cumsum(self.counts) - self.counts
        emit = (np.add.reduceat(weights[self.slots], starts, axis=0) * scale)[self.index]
        expected = np.zeros((k, k))
        p = marginals(emit, trans, np.array([len(self.index)]), pairs=expected)
        diff = -p
        diff[np.arange(len(p)), self.tags] += 1
        by_word = np.stack([np.bincount(self.index, diff[:, j], len(self.counts)) for j in range(k)], 1) * scale
        row_of = np.repeat(np.arange(len(self.counts)), self.counts)
        grad = np.stack([np.bincount(self.slots, by_word[row_of, j], SLOTS) for j in range(k)], 1)
        seen = np.bincount(self.tags[:-1].astype(int) * k + self.tags[1:], minlength=k * k).reshape(k, k)
        return grad, seen - expected


def ascend(gradient, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by AdaGrad; gradient(weights, trans) = (gradient by weights,
    by transitions, words)."""
    weights, trans = np.zeros((SLOTS, k), np.float32), np.zeros((k, k))
    seen_w, seen_t = np.full((SLOTS, k), 1e-3, np.float32), np.full((k, k), 1e-3)
    for _ in range(rounds):
        grad, grad_t, words = gradient(weights, trans)
        grad = (grad / 1000 - PENALTY * words / 1000 * weights).astype(np.float32)
        grad_t = grad_t / 1000 - PENALTY * words * trans
        seen_w += grad**2
        seen_t += grad_t**2
        weights += RATE * grad / np.sqrt(seen_w)
        trans += RATE * grad_t / np.sqrt(seen_t)
    return weights, trans


def fit(docs: DataFrame, train, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on documents with a lang for which `train` holds."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & train)
    rows = rows.select("text", "lang", F.xxhash64("doc_id", "lang").alias("h"), F.xxhash64("text").alias("t"))
    keys = rows.select("h", "t", "lang").distinct().orderBy("h", "t", "lang").limit(fit_docs)
    chosen = common.materialize(rows.join(F.broadcast(keys), ["h", "t", "lang"], "left_semi").dropDuplicates(["h", "t", "lang"]), "langid-fit")
    langs = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())  # at most fit_docs
    k = len(langs)
    if k < 2:
        return Model(langs, np.zeros((SLOTS, k), np.float32), np.zeros((k, k)))

    def chains(batches):
        """Chains of about CHAIN words of the pieces of one partition."""
        pieces: list[tuple[int, list[str], int]] = []
        held = 0

        def out():
            ordered = sorted(pieces)
            chain = Chain([w for _, words, _ in ordered for w in words], np.repeat([tag for *_, tag in ordered], [len(words) for _, words, _ in ordered]))
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in chain.pack()], names=["words", "tags", "counts", "slots"])

        for batch in batches:
            for h, text, lang in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words = words_of(text)
                for i in range(0, len(words), PIECE):
                    pieces.append((int(common.mix64(np.array([h + i * 0x9E3779B9], np.int64).view(np.uint64))[0]), words[i : i + PIECE], langs.index(lang)))
                    held += len(pieces[-1][1])
                    if held >= CHAIN:
                        yield out()
                        pieces.clear()
                        held = 0
        if pieces:
            yield out()

    spread = chosen.repartition(PARTS, "h", "t").sortWithinPartitions("h", "t", "lang")
    data = common.materialize(spread.mapInArrow(chains, "words binary, tags binary, counts binary, slots binary"), "langid-chains")

    def gradient(weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        shared = spark.sparkContext.broadcast((weights, trans))

        def sums(batches):
            total = None
            for batch in batches:
                for cells in zip(*(batch.column(c).to_pylist() for c in ("words", "tags", "counts", "slots"))):
                    chain = Chain.unpack(cells)
                    grad, grad_t = chain.gradient(*shared.value)
                    total = [grad, grad_t, len(chain.index)] if total is None else [total[0] + grad, total[1] + grad_t, total[2] + len(chain.index)]
            if total is not None:
                at = np.flatnonzero(total[0].any(1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (at.tobytes(), total[0][at].astype(np.float32).tobytes(), total[1].tobytes())] + [pa.array([total[2]], pa.int64())], names=["at", "grad", "pairs", "n"])

        whole, pairs, n = np.zeros((SLOTS, k)), np.zeros((k, k)), 0
        # PARTS rows of at most SLOTS * k numbers
        for r in data.coalesce(PARTS).mapInArrow(sums, "at binary, grad binary, pairs binary, n long").collect():
            whole[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["grad"], np.float32).reshape(-1, k)
            pairs += np.frombuffer(r["pairs"], np.float64).reshape(k, k)
            n += r["n"]
        shared.destroy()
        return whole, pairs, n

    return Model(langs, *ascend(gradient, k))


class Tagger:
    """A model with a bounded cache of emission scores, one a Python worker."""

    def __init__(self, model: Model) -> None:
        self.model, self.ids, self.rows = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def lookup(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        new = list({w for w in words if w not in ids})
        if len(ids) + len(new) > CACHE:
            ids.clear()
            self.rows = self.rows[:0]
            new = list(set(words))
        if new:
            ids.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, self.model.emissions(new).astype(np.float32)])
        return self.rows[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word probabilities of all texts, words of each text, and sums by text."""
        words = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for x in words for w in x]
        k = len(self.model.langs)
        if not flat or not k:
            return np.zeros((0, k)), lengths, np.zeros((len(texts), k))
        p = marginals(self.lookup(flat), self.model.trans, lengths)
        text_of = np.repeat(np.arange(len(texts)), lengths)
        return p, lengths, np.stack([np.bincount(text_of, p[:, j], len(texts)) for j in range(k)], 1)


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, words, langs: the likeliest label of each word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            for part in common.slices(batch, size=1 << 20):
                texts = part.column("text").to_pylist()
                p, lengths, _ = tagger.tag(texts)
                best = p.argmax(1) if len(p) else np.array([], int)
                ends = np.cumsum(lengths)
                names = [[shared.value.langs[j] for j in best[e - n : e]] for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([words_of(t) for t in texts], pa.list_(pa.string())), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "words", "langs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<string>, langs array<string>")


def _predict(shared, batches):
    tagger = Tagger(shared.value)
    langs = shared.value.langs
    for batch in batches:
        for part in common.slices(batch, size=1 << 20):
            _, lengths, sums = tagger.tag(part.column("text").to_pylist())
            known = (lengths > 0) & (len(langs) > 0)
            best = sums.argmax(1) if langs else np.zeros(len(lengths), int)
            score = np.where(known, sums.max(1) / np.maximum(lengths, 1), 0.0) if langs else np.zeros(len(lengths))
            pred = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    return docs.select("doc_id", "text").mapInArrow(partial(_predict, docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose remainder by 4 is not 2. Null
    texts and texts without a letter are `und`; null langs are not learned from; repeated
    rows are scored row by row; an empty table gives an empty result; other columns are not
    read."""
    docs = common.documents(spark, sf_dir)
    model = fit(docs, ~common.is_remainder("doc_id", 4, 2))
    return identify(docs, model).select("doc_id", common.is_remainder("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
