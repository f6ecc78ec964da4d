"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds its
letters' vectors, each rotated by its place, with a product; a text's vector
bundles its n-grams' vectors with a sum; a language's prototype bundles the
texts that are known to be in it.  A text is in the language whose prototype
has the greatest cosine with its vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import as_text, map_batches

DIMENSIONS, GRAM, UNKNOWN = 1024, 3, "und"
#: n-gram vectors that a task keeps; further ones are bound again each time.
KEPT = 12_000
#: n-grams whose vectors are summed up at a time.
CHUNK = 1000


class Profiles:
    """Letter vectors and the vectors of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.known = np.array([chr(c).isalpha() for c in range(0x30000)])
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((256, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if (v := self.letters.get(code)) is None:
            v = self.letters[code] = np.random.default_rng([code, 77]).integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1
        return v

    def bind(self, code: int) -> np.ndarray:
        """The product of the n-gram's letter vectors, rotated by their distance from its end."""
        out = np.ones(self.dimensions, np.float32)
        for k in range(self.gram):
            out = out * np.roll(self.letter((code >> (21 * k)) & 0x1FFFFF), k)
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the text's n-grams; everything between letters is one gap."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.known[np.minimum(codes, len(self.known) - 1)]
        for i in np.flatnonzero(codes >= len(self.known)):
            letter[i] = chr(codes[i]).isalpha()
        if not letter.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.int64)
        symbols = symbols[np.append(True, (symbols[1:] != 0) | (symbols[:-1] != 0))]
        joined = np.zeros(max(len(symbols) - self.gram + 1, 0), np.int64)
        for k in range(self.gram):
            joined = (joined << 21) | symbols[k : k + len(joined)]
        return np.unique(joined, return_counts=True)

    def matrix(self, codes: list[int]) -> np.ndarray:
        rows = []
        for c in codes:
            row = self.rows.get(c)
            if row is None:
                if len(self.rows) >= KEPT:
                    return np.stack([self.vectors[self.rows[x]] if x in self.rows else self.bind(x) for x in codes])
                row = self.rows[c] = len(self.rows)
                if row == len(self.vectors):
                    self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
                self.vectors[row] = self.bind(c)
            rows.append(row)
        return self.vectors[rows]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors, times their counts; CHUNK of them are held at a time, however long the text."""
        total = np.zeros(self.dimensions)
        for k in range(0, len(codes), CHUNK):
            total += counts[k : k + CHUNK].astype(np.float32) @ self.matrix(codes[k : k + CHUNK].tolist())
        return total


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The prototype of each language in `labelled` (text, lang).

    Tasks bundle what they read, and one vector a task and language is summed
    up; the driver gets one vector a language.
    """

    def work():
        profiles = Profiles(dimensions, gram)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sums: dict[str, dict[int, int]] = {}
            for text, lang in zip(as_text(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                codes, counts = profiles.grams(text)
                own = sums.setdefault(lang, {})
                for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    own[c] = own.get(c, 0) + n
            langs, values = [], []
            for lang, own in sums.items():
                total = profiles.bundle(np.array(list(own), np.int64), np.array(list(own.values()), np.int64))
                langs.append(lang)
                values.append(total.tolist())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(values, pa.list_(pa.float64()))], ["lang", "sums"])

        return step

    parts = map_batches(labelled.select("text", "lang"), work, "lang string, sums array<double>")
    summed = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("value"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("vector")).collect()
    return {r["lang"]: np.array([x["value"] for x in r["vector"]]) for r in rows}


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether a document is kept from learning, by the checksum of its id's text; a null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """The language of every whole text.

    Learns from the texts that have a lang and aren't held out, and predicts
    from text alone.  Returns doc_id, held_out, lang_pred and score (the
    cosine with the prototype, 0 to 1).

    A null text, or one without letters, is `und` with score 0, and so is
    every text if there is nothing to learn from.  Equal cosines go to the
    first language in order.  Repeated rows are learnt from and judged each.
    Null ids are learnt from.  Clashing other columns change nothing; no rows
    give no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id")).alias("held_out"))
    learnt = prototypes(own.where("lang IS NOT NULL AND text IS NOT NULL AND NOT held_out"), dimensions, gram)
    learnt = {k: v for k, v in learnt.items() if np.linalg.norm(v)}
    names = sorted(learnt)
    unit = np.array([learnt[k] / np.linalg.norm(learnt[k]) for k in names], np.float32)

    def work():
        profiles = Profiles(dimensions, gram)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, scores = [], []
            for text in as_text(batch.column("text")):
                codes, counts = profiles.grams(text)
                vector = profiles.bundle(codes, counts) if len(codes) else np.zeros(dimensions)
                norm = float(np.linalg.norm(vector))
                if not norm or not names:
                    found.append(UNKNOWN), scores.append(0.0)
                    continue
                cosines = unit @ vector / norm
                best = int(np.argmax(cosines))
                found.append(names[best])
                scores.append(float(np.clip(cosines[best], 0, 1)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return step

    return map_batches(own.select("doc_id", "text", "held_out"), work, "doc_id long, held_out boolean, lang_pred string, score double")
