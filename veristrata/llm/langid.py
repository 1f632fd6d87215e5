"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads runs of words in both directions, its state running on across
the words and what stands between them, and labels every byte position with
language probabilities; a document's probabilities pool the log probabilities
of all positions in words with a letter.  A run is what starts in the same
``SPAN`` bytes of a text, so that runs of all texts are read side by side; at the
next run the state starts afresh.  Training is plain backpropagation through
time in numpy, with Adam, on a bounded sample.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if no labelled row exists; a language of one sample row is
learned like any other; a very long text is read whole; of languages that tie the
first by name counts; repeated rows get equal results; an empty table gives an
empty result; extra columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from veristrata.llm.session import bounded_batches, col, crc_mod, free_names, give_back, table
from veristrata.llm.words import chunks

#: Bounds of the training sample: documents a language, characters of each (a window at a hashed place).
SAMPLE_DOCS, SAMPLE_CHARS = 96, 2000
#: Runs that are read in training, for each language.
SAMPLE_RUNS = 5000
HIDDEN = 12
#: Bytes of a text in which the words of a run start, and those of the short runs that are learned from as well.
SPAN, SHORT = 160, 24
#: A longer word stands for several, of this many bytes each.
PIECE = 48
#: Runs read at once, of up to 16 languages; of more languages accordingly fewer.
READ_RUNS = 512
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class BiGRU:
    """Parameters are float32 arrays in ``p``; direction d has ``x{d}`` (256, 3H), ``u{d}`` (H, 3H), ``c{d}`` (H,), ``o{d}`` (H, L)."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.h, self.labels = hidden, n_labels
        self.p = {"b": np.zeros(n_labels, np.float32)}
        for d in "fb":
            self.p |= {
                "x" + d: rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
                "u" + d: rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32),
                "c" + d: np.zeros(hidden, np.float32),
                "o" + d: rng.normal(0, hidden**-0.5, (hidden, n_labels)).astype(np.float32),
            }

    @staticmethod
    def _sigmoid(x):
        return 0.5 * np.tanh(0.5 * x) + 0.5

    def _run(self, d: str, codes: np.ndarray, active: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Position logits of one direction, (T, n, L). Rows are sorted by length, longest first."""
        H, p = self.h, self.p
        n, T = codes.shape
        h = np.zeros((n, H), np.float32)
        out = np.zeros((T, n, self.labels), np.float32)
        for t in range(T):
            m = active[t]
            x = p["x" + d][codes[:m, t]]
            rec = h[:m] @ p["u" + d]
            zr = self._sigmoid(x[:, : 2 * H] + rec[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            inner = rec[:, 2 * H :] + p["c" + d]
            c = np.tanh(x[:, 2 * H :] + r * inner)
            new = c + z * (h[:m] - c)
            if keep is not None:
                keep.append((h[:m].copy(), z, r, inner, c, new))
            h[:m] = new
            out[t, :m] = new @ p["o" + d]
        return out

    @staticmethod
    def _layout(codes: np.ndarray, lengths: np.ndarray):
        T = int(lengths[0])
        codes = codes[:, :T]
        at = np.arange(T)
        back = np.clip(lengths[:, None] - 1 - at, 0, None)
        inside = at < lengths[:, None]
        return codes, np.take_along_axis(codes, back, 1), back, inside, inside.sum(axis=0)

    def _states(self, d: str, at: np.ndarray, active: np.ndarray) -> np.ndarray:
        """One direction's states at each position, (T, n, H), from codes (T, n), longest column first; zero where a row has ended.

        The gates are those of ``_run``; that a sigmoid is half of a tanh and a half is put into the weights.
        """
        H, half = self.h, np.float32(0.5)
        parts = [slice(k * H, (k + 1) * H) for k in range(3)]
        x = [np.ascontiguousarray(self.p["x" + d][:, s]) * w for s, w in zip(parts, (half, half, np.float32(1)), strict=True)]
        u = [np.ascontiguousarray(self.p["u" + d][:, s]) * half for s in parts]
        bias = self.p["c" + d] * half
        out = np.zeros((*at.shape, H), np.float32)
        before = np.zeros(out.shape[1:], np.float32)
        for t in range(len(at)) if d == "f" else range(len(at) - 1, -1, -1):
            m = active[t]
            read, was, new = at[t, :m], before[:m], out[t, :m]
            keep, reset, inner = x[0][read], x[1][read], was @ u[2]
            keep += was @ u[0]
            reset += was @ u[1]
            np.tanh(keep, out=keep)
            np.tanh(reset, out=reset)
            inner += bias
            reset += 1
            inner *= reset
            inner += x[2][read]
            np.tanh(inner, out=inner)
            keep += 1
            keep *= half
            np.subtract(was, inner, out=new)
            new *= keep
            new += inner
            before = out[t]
        return out

    def log_probs(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per position log probabilities (L, T, n) and which positions exist (T, n); rows longest first."""
        T = int(lengths[0])
        inside = np.arange(T)[:, None] < lengths
        at, active = codes[:, :T].T.astype(np.intp), inside.sum(axis=1)
        logits = self.p["b"][:, None].repeat(at.size, axis=1)
        for d in "fb":
            logits += self.p["o" + d].T @ self._states(d, at, active).reshape(-1, self.h).T
        logits -= logits.max(axis=0)
        logits -= np.log(np.exp(logits).sum(axis=0))
        return logits.reshape(-1, *inside.shape), inside

    def run_scores(self, buf: np.ndarray, counted: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = READ_RUNS) -> np.ndarray:
        """Sum over each run's counted positions of the log probabilities, (n, L); only a block's runs are laid out at once."""
        order = np.argsort(starts - ends, kind="stable")
        block = max(1, block * 16 // max(16, self.labels))
        out = np.zeros((len(starts), self.labels), np.float64)
        for i in range(0, len(order), block):
            rows = order[i : i + block]
            lengths = ends[rows] - starts[rows]
            logp, inside = self.log_probs(byte_matrix(buf, starts[rows], lengths), lengths)
            logp *= inside & byte_matrix(counted, starts[rows], lengths).T
            out[rows] = logp.sum(axis=1).T
        return out

    def gradients(self, codes: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over positions and its gradients by backpropagation through time."""
        H, p = self.h, self.p
        ahead, behind, back, inside, active = self._layout(codes, lengths)
        kept = {"f": [], "b": []}
        f = self._run("f", ahead, active, kept["f"]).transpose(1, 0, 2)
        b = self._run("b", behind, active, kept["b"]).transpose(1, 0, 2)
        logits = f + np.take_along_axis(b, back[:, :, None], 1) + p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        total = inside.sum()
        rows = np.arange(len(target))
        loss = -np.log(prob[rows[:, None], np.arange(prob.shape[1]), target[:, None]] + 1e-12)[inside].sum() / total
        prob[rows, :, target] -= 1
        delta = (prob * inside[:, :, None] / total).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["b"] = delta.sum(axis=(0, 1))
        for d, seq, dl in (("f", ahead, delta), ("b", behind, np.take_along_axis(delta, back[:, :, None], 1) * inside[:, :, None])):
            dh = np.zeros((len(target), H), np.float32)
            for t in range(seq.shape[1] - 1, -1, -1):
                m = active[t]
                h, z, r, inner, c, new = kept[d][t]
                dy = dl[:m, t]
                g["o" + d] += new.T @ dy
                dn = dh[:m] + dy @ p["o" + d].T
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * inner * r * (1 - r)
                di = dc * r
                pre = np.concatenate([dz, dr, di], axis=1)
                g["u" + d] += h.T @ pre
                g["c" + d] += di.sum(axis=0)
                np.add.at(g["x" + d], seq[:m, t], np.concatenate([dz, dr, dc], axis=1))
                dh[:m] = dn * z + pre @ p["u" + d].T
        return float(loss), g

    def fit(self, codes: np.ndarray, lengths: np.ndarray, target: np.ndarray, epochs: int = 3, batch: int = 128, rate: float = 0.01, seed: int = 6) -> BiGRU:
        """Batches hold runs of like lengths, in a drawn order."""
        rng = np.random.Generator(np.random.PCG64(seed))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        total = epochs * -(-len(target) // batch)
        for _ in range(epochs):
            drawn = rng.permutation(len(target))
            drawn = drawn[np.argsort(-lengths[drawn], kind="stable")]
            for i in rng.permutation(np.arange(0, len(drawn), batch)).tolist():
                rows = drawn[i : i + batch]
                _, g = self.gradients(codes[rows], lengths[rows], target[rows])
                now = rate * (1 - 0.9 * step / total)
                step += 1
                for k, v in g.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v * v - second[k])
                    self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self


def runs(chunk, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, doc)`` of what the network reads, and which bytes of the chunk stand in words with a letter.

    A run begins and ends with such a word, or a piece of a long one; those that start within the same
    ``span`` bytes, counted from the text's first, make one run.
    """
    marks = np.zeros(len(chunk.buf) + 1, dtype=np.int32)
    np.cumsum(_LETTER[chunk.buf], out=marks[1:])
    real = marks[chunk.ends] > marks[chunk.starts]
    starts, ends, doc = chunk.starts[real], chunk.ends[real], chunk.doc[real]
    edges = np.zeros(len(chunk.buf) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    counted = np.cumsum(edges[:-1], dtype=np.int8) > 0
    parts = np.maximum(1, -(-(ends - starts) // PIECE))
    if (parts > 1).any():
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends, doc = np.repeat(starts, parts) + k * PIECE, np.repeat(ends, parts), np.repeat(doc, parts)
        ends = np.minimum(ends, starts + PIECE)
    if not len(starts):
        return starts, ends, doc, counted
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    place = (starts - starts[first][np.cumsum(first) - 1]) // span
    at = np.flatnonzero(first | np.concatenate([[True], place[1:] != place[:-1]]))
    return starts[at], ends[np.append(at[1:], len(ends)) - 1], doc[at], counted


def byte_matrix(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    width = int(lengths.max()) if len(lengths) else 1
    at = np.minimum(starts[:, None] + np.arange(width), len(buf) - 1)
    return buf[at]


class Identifier:
    """A trained network and its languages."""

    def __init__(self, languages: list[str], net: BiGRU | None):
        self.languages, self.net = languages, net

    def predict(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the best language's index and the pooled probability of it."""
        starts, ends, doc, counted = runs(chunk)
        if not len(starts):
            return np.zeros(chunk.n, np.int64), np.zeros(chunk.n)
        scores = self.net.run_scores(chunk.buf, counted, starts, ends)
        sums = np.zeros(len(counted) + 1, np.int32)
        np.cumsum(counted, out=sums[1:])
        positions = np.maximum(chunk.per_doc((sums[ends] - sums[starts]).astype(float), doc), 1)
        pooled = np.stack([chunk.per_doc(scores[:, k], doc) for k in range(len(self.languages))], axis=1) / positions[:, None]
        pooled = np.exp(pooled - pooled.max(axis=1, keepdims=True))
        pooled /= pooled.sum(axis=1, keepdims=True)
        return pooled.argmax(axis=1), pooled.max(axis=1)


def training_sample(docs: DataFrame, learn) -> list[tuple[str, bytes]]:
    """At most SAMPLE_DOCS windows a language, chosen by the least hash in each of as many buckets."""
    spark = docs.sparkSession
    seen = F.xxhash64(F.lit("langid"), F.col("doc_id"))
    labelled = docs.where(F.col("lang").isNotNull() & learn)
    chosen = labelled.select("lang", "doc_id", seen.alias("h")).groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("k")).agg(F.min(F.struct("h", "doc_id")).alias("m"))
    ids = [(r.lang, r.doc_id) for r in chosen.select("lang", "m.doc_id").collect()]
    if not ids:
        return []
    small = spark.createDataFrame(ids, labelled.select("lang", "doc_id").schema)
    width = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    window = F.expr(f"substring(text, cast(1 + pmod(xxhash64(doc_id, text), _w) as int), {SAMPLE_CHARS})")
    rows = labelled.join(F.broadcast(small), ["lang", "doc_id"]).withColumn("_w", width).select("lang", "doc_id", window.alias("t")).groupBy("lang", "doc_id").agg(F.min("t").alias("t"))
    return sorted((r.lang, r.t.encode("utf-8", "surrogatepass")) for r in rows.collect() if r.t)


def train(sample: list[tuple[str, bytes]], most_runs: int | None = None) -> Identifier:
    """A network for every language of the sample, from ``SAMPLE_RUNS`` runs a language if not told otherwise."""
    languages = sorted({lang for lang, _ in sample})
    most_runs = SAMPLE_RUNS * len(languages) if most_runs is None else most_runs
    if not languages:
        return Identifier([], None)
    parts, targets = [], []
    # Of each window a quarter is read again in short runs, like short texts, and a fifth in capitals, which are rare in the sample but not in texts.
    quarters = [(lang, text[: len(text) // 4], SHORT) for lang, text in sample]
    capitals = [(lang, text[: len(text) // 5].decode("utf-8", "ignore").upper().encode(), SHORT) for lang, text in sample]
    for lang, text, span in [(*s, SPAN) for s in sample] + quarters + capitals:
        for _, _, chunk in chunks(pa.array([text], pa.binary())):
            starts, ends, _, _ = runs(chunk, span)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                parts.append(chunk.buf[s:e])
                targets.append(languages.index(lang))
    if not parts:
        return Identifier([], None)
    drawn = np.random.Generator(np.random.PCG64(4)).permutation(len(parts))[:most_runs]
    lengths = np.array([len(parts[i]) for i in drawn])
    codes = np.zeros((len(drawn), lengths.max()), np.uint8)
    for row, i in enumerate(drawn):
        codes[row, : len(parts[i])] = parts[i]
    target = np.array(targets)[drawn]
    return Identifier(languages, BiGRU(len(languages)).fit(codes, lengths, target))


def identify(docs: DataFrame, model: Identifier, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep``, the language and its score (columns ``names``) of every whole text; one narrow pass."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [col(c) for c in keep]
    schema = t.StructType([*docs.select(*kept).schema.fields, t.StructField(names[0], t.StringType()), t.StructField(names[1], t.DoubleType())])
    labels = np.array([*model.languages, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has, raw = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool), batch.column(at)
            best, score = np.full(len(raw), len(labels) - 1), np.zeros(len(raw))
            if model.net is not None:
                for i, j, chunk in chunks(raw):
                    best[i:j], score[i:j] = model.predict(chunk)
            best[~has], score[~has] = len(labels) - 1, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(labels[best], pa.string()), pa.array(score)], names=schema.names)
        give_back()

    # A text that is kept anyway is read where it stands, not sent twice.
    at = keep.index("text") if "text" in keep else len(keep)
    raw = [] if "text" in keep else [text.cast("binary").alias(free_names(docs, "raw")[0])]
    rows = docs.select(*kept, *raw, text.rlike("\\p{L}").alias(free_names(docs, "letter")[0]))
    return rows.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = crc_mod("doc_id", 3)
    model = train(training_sample(docs, part != 1))
    found = identify(docs.select("doc_id", "text", F.coalesce(part == 1, F.lit(False)).alias("held_out")), model, "doc_id", "held_out")
    return found.select("doc_id", "held_out", "lang_pred", "score")
