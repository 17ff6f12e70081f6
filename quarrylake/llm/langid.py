"""Language identification by hyperdimensional letter-trigram profiles."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 1024
SEED = 20240229
#: Most trigram vectors that a worker holds; beyond, it starts anew.
CACHE_ROWS = 16_384
UNKNOWN = "und"


class Encoder:
    """Letter trigrams of texts, and their hypervectors.

    Every letter has a random vector of +1 and -1. A trigram's vector is the product of its letters' vectors, the first
    rotated by two places and the second by one. A run of anything but letters counts as one separating letter.
    """

    def __init__(self, dimension: int = DIMENSION) -> None:
        import numpy as np

        self.np, self.dimension = np, dimension
        self.letter = np.full(0x110000, -1, np.int8)
        self.letters: dict[int, object] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((1024, dimension), np.float32)

    def trigrams(self, text: bytes | None):
        """(codes, counts) of a text in UTF-8, of which other bytes are no letters; none if it has no letter."""
        np = self.np
        if not text:
            return None
        points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if (new := self.letter[points] < 0).any():
            for c in np.unique(points[new]).tolist():
                self.letter[c] = chr(c).isalpha()
        is_letter = self.letter[points] > 0
        if not is_letter.any():
            return None
        held = np.where(is_letter, points, 32).astype(np.int64)
        held = np.concatenate(([32], held, [32]))
        gap = held == 32
        held = held[~(gap & np.concatenate(([False], gap[:-1])))]
        return np.unique((held[:-2] << 42) | (held[1:-1] << 21) | held[2:], return_counts=True)

    def _letter(self, point: int):
        if point not in self.letters:
            bits = self.np.random.Generator(self.np.random.PCG64([SEED, point])).integers(0, 2, self.dimension)
            self.letters[point] = (2 * bits - 1).astype(self.np.float32)
        return self.letters[point]

    def bundle(self, codes, counts):
        """The hypervector of counted trigrams."""
        np = self.np
        out = np.zeros(self.dimension, np.float64)
        exact = np.float32 if counts.sum() < 1 << 24 else np.float64  # whole numbers up to here have no rounding
        for at in range(0, len(codes), CACHE_ROWS):
            part = codes[at : at + CACHE_ROWS].tolist()
            if len(self.rows) + len(part) > CACHE_ROWS:
                self.rows.clear()
            for code in part:
                if code not in self.rows:
                    k = self.rows[code] = len(self.rows)
                    if k >= len(self.matrix):
                        self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                    a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
                    self.matrix[k] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            out += counts[at : at + CACHE_ROWS].astype(exact) @ self.matrix[[self.rows[c] for c in part]]
        return out


def is_held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold; a null id never does."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimension: int = DIMENSION) -> dict[str, object]:
    """{language: prototype}: the bundled trigram vectors of all texts of the language.

    Each task counts trigrams by language and returns one vector for each; the sums, languages times dimension, are all that
    reaches the driver. Rows without language or letters teach nothing.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder, sums = Encoder(dimension), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := encoder.trigrams(text)) is not None:
                    own = sums.setdefault(lang, ([], []))
                    own[0].append(found[0])
                    own[1].append(found[1])
            for own in sums.values():
                codes, where = np.unique(np.concatenate(own[0]), return_inverse=True)
                own[1][:] = [np.bincount(where, np.concatenate(own[1]), len(codes))]
                own[0][:] = [codes]
        vectors = [encoder.bundle(codes[0], counts[0]).tolist() for codes, counts in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(vectors, pa.list_(pa.float64()))], names=["lang", "v"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = known.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("at", "x"))
    # whole numbers only: sums are exact, so their order does not matter
    sums = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).orderBy("lang").collect()
    return {r["lang"]: [x["x"] for x in r["v"]] for r in sums}


def predict(docs: DataFrame, prototypes: dict[str, object], text_col: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """docs with lang_pred and score (cosine to the nearest prototype, 0 to 1) in place of the text.

    Null texts and texts without a letter get und and 0, as does every text if there are no prototypes. Ties go to the
    language that sorts first. Only the text is used.
    """
    languages = sorted(prototypes)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(dimension)
        known = np.array([prototypes[x] for x in languages], np.float64).reshape(len(languages), dimension)
        known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)
        for batch in batches:
            names, scores = [], []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                name, score = UNKNOWN, 0.0
                if languages and (found := encoder.trigrams(text)) is not None:
                    v = encoder.bundle(*found)
                    cosines = known @ v / max(np.linalg.norm(v), 1e-12)
                    best = int(np.argmax(np.round(cosines, 12)))
                    name, score = languages[best], float(min(1.0, max(0.0, cosines[best])))
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rest = docs.drop(text_col, "lang_pred", "score")
    schema = rest.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select(*(F.col(c) for c in rest.columns), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs, learned from the rows that are not held out.

    Null ids are never held out. Null texts and texts without a letter are und; bytes that are not UTF-8 count as no letters.
    Repeated rows teach as often as they occur and each get their row. With nothing to learn from all texts are und. An empty
    table gives an empty result; other columns are not read.
    """
    held = is_held_out(F.col(id_col))
    prototypes = train(docs.where(~held), text_col, lang_col)
    return predict(docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")), prototypes)
