"""Language identification: a convolutional network over bytes, trained in numpy.

A text is lower-cased, encoded as UTF-8 and cut into windows of 256 bytes, the last one padded with zero bytes. Each byte
has a learnt vector; filters two, three and four bytes wide slide over the window; each filter's largest response over the
window, if positive, is a feature; a softmax over the features gives the window's languages. A text's score averages its
windows' log probabilities, weighted by their bytes, over the whole text.

Filters of all widths are one matrix four bytes wide, with zeros outside a narrow filter, so that a batch of windows takes
one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = {2: 8, 3: 12, 4: 12}
VECTOR = 8
UNKNOWN = "und"
#: Training takes at most so many texts in all (one of each language at least), and so many windows of each text.
SAMPLE_DOCS = 4_000
SAMPLE_WINDOWS = 8
_BATCH = 256
_WIDEST = max(WIDTHS)


def windows(text: bytes) -> np.ndarray:
    """Rows of WINDOW bytes, at least one."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """vectors[256, VECTOR], filters[_WIDEST * VECTOR, features], dense[features, languages] with their biases."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        features = sum(WIDTHS.values())
        self.mask = np.zeros((_WIDEST * VECTOR, features), np.float32)
        at = 0
        for width, many in WIDTHS.items():
            self.mask[: width * VECTOR, at : at + many] = 1
            at += many
        scale = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        self.p = {
            "vectors": rng.standard_normal((256, VECTOR)).astype(np.float32) * 0.5, "filters": scale(_WIDEST * VECTOR, features) * self.mask,
            "shift": np.zeros(features, np.float32), "dense": scale(features, len(languages)), "bias": np.zeros(len(languages), np.float32),
        }

    def _columns(self, rows: np.ndarray) -> np.ndarray:
        x = self.p["vectors"][rows].reshape(len(rows), WINDOW * VECTOR)
        at = np.lib.stride_tricks.sliding_window_view(x, _WIDEST * VECTOR, axis=1)[:, ::VECTOR]
        return np.ascontiguousarray(at)  # windows, positions, _WIDEST * VECTOR

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(self.languages)))
        for a in range(0, len(rows), _BATCH):
            response = self._columns(rows[a : a + _BATCH]) @ self.p["filters"]
            feature = np.maximum(response.max(1) + self.p["shift"], 0)
            z = (feature @ self.p["dense"] + self.p["bias"]).astype(np.float64)
            z -= z.max(1, keepdims=True)
            out[a : a + _BATCH] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def fit(self, rows: np.ndarray, labels: np.ndarray, steps: int = 700, batch: int = 128, rate: float = 4e-3, seed: int = 1) -> Network:
        """Adam on cross-entropy; classes are drawn evenly; some windows are cut short, as those of short texts are."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            y = rng.integers(0, len(by_class), batch)
            x = rows[[by_class[k][rng.integers(0, len(by_class[k]))] for k in y]].copy()
            for i in np.flatnonzero(rng.random(batch) < 0.3):
                x[i, rng.integers(12, WINDOW) :] = 0
            columns = self._columns(x)
            response = columns @ self.p["filters"]
            best = response.argmax(1)
            raw = np.take_along_axis(response, best[:, None], 1)[:, 0] + self.p["shift"]
            feature = np.maximum(raw, 0)
            z = feature @ self.p["dense"] + self.p["bias"]
            z = np.exp(z - z.max(1, keepdims=True))
            slope = z / z.sum(1, keepdims=True)
            slope[np.arange(batch), y] -= 1
            slope /= batch
            back = (slope @ self.p["dense"].T) * (raw > 0)
            taken = np.take_along_axis(columns, best[:, :, None], 1)  # windows, features, _WIDEST * VECTOR
            to_vectors = (back[:, :, None] * self.p["filters"].T[None]).reshape(-1, VECTOR)
            used = np.take_along_axis(x[:, None, :], (best[:, :, None] + np.arange(_WIDEST)), 2).reshape(-1)
            vectors = np.zeros_like(self.p["vectors"])
            np.add.at(vectors, used, to_vectors)
            slopes = {
                "vectors": vectors, "filters": np.einsum("bf,bfc->cf", back, taken) * self.mask, "shift": back.sum(0),
                "dense": feature.T @ slope, "bias": slope.sum(0),
            }
            for k, g in slopes.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = (self.p[k] - rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evenly spaced windows of each text."""
    for batch in batches:
        langs, ranks, rows = [], [], []
        for lang, rank, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = windows(text.lower().encode())
            for i in np.unique(np.linspace(0, len(own) - 1, SAMPLE_WINDOWS).astype(int)):
                langs.append(lang)
                ranks.append(rank)
                rows.append(own[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ranks, pa.int64()), pa.array(rows, pa.binary())], ["lang", "rank", "bytes"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """A network from docs(doc_id, text, lang) for every lang in them; None if no row has a text with a letter and a lang.

    Takes an even share of sample_docs texts of each lang (one at least), those with the smallest hashes of id and text, and of
    each text SAMPLE_WINDOWS windows, evenly spaced from its first to its last.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("doc_id", "text").alias("rank"))
    many = rows.groupBy("lang").count().collect()  # a row for each language
    if not many:
        return None
    share = max(1, sample_docs // len(many))
    wanted = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * share / r["count"] + 20 / r["count"])) for r in many], "lang string, share double")
    some = rows.join(F.broadcast(wanted), "lang").where((F.col("rank").cast("double") / 2.0**64 + 0.5) <= F.col("share"))
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("at") <= share)
    table = some.select("lang", "rank", "text").mapInArrow(_sampled, "lang string, rank long, bytes binary").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending"), ("bytes", "ascending")])
    if not table.num_rows:
        return None
    languages, labels = np.unique(np.array(table.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    pixels = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return Network([str(x) for x in languages]).fit(pixels, labels)


def predict(docs: DataFrame, network: Network | None, held_out) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, held_out, lang_pred, score.

    lang_pred is UNKNOWN with score 0 where the text is null or has no letter (Unicode category L; numerals such as Roman ones
    or fractions are none), or where there is no network. Every window of a text is read, however long it is; a text's windows
    are held at once, 256 at a time go through the network. Ids, langs and sources play no part; repeated rows, null ids and
    other columns are fine; an empty table gives an empty one.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for batch in batches:
            values = batch.column(1).to_pylist()
            langs, scores = [UNKNOWN] * len(values), np.zeros(len(values))
            known = [i for i, t in enumerate(values) if net and t and any(map(str.isalpha, t))]
            at = 0
            while at < len(known):  # a few MB of text at a time
                to, size, parts = at, 0, []
                while to < len(known) and (not parts or size < 1 << 21):
                    parts.append(values[known[to]].lower().encode())
                    size += len(parts[-1])
                    to += 1
                rows = [windows(p) for p in parts]
                sizes = np.array([len(r) for r in rows])
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                weight = np.full(sizes.sum(), float(WINDOW))
                weight[first + sizes - 1] = [len(p) - WINDOW * (n - 1) for p, n in zip(parts, sizes, strict=True)]
                logs = net.log_probabilities(np.concatenate(rows)) * weight[:, None]
                mean = np.add.reduceat(logs, first) / np.array([len(p) for p in parts])[:, None]
                chance = np.exp(mean - mean.max(1, keepdims=True))
                chance /= chance.sum(1, keepdims=True)
                for i, k, c in zip(known[at:to], chance.argmax(1), chance.max(1), strict=True):
                    langs[i], scores[i] = net.languages[k], c
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
