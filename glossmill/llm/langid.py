"""Language identification by interpolated Kneser-Ney character models.

A text becomes a sequence of symbols: lower-cased letters and marks, and one separator for each run of anything else. Each
language has a model of ``order`` symbols. For every order the n-grams that any language has are one sorted array
of 64-bit hashes with the log-probabilities of all languages beside it, and contexts likewise with their weights
of falling back, so a position costs one binary search, or one for each order that it falls back. The language of
the lowest cross-entropy per symbol wins (ties: the least name). For rejection every segment counts by its own best
language, so a text of two languages is as plausible as one of each; thresholds are calibrated on the segments of
sampled documents that the models were not fitted on.

Models are fitted on a bounded sample: of each language about ``sample`` documents, those of the smallest hashes
of doc_id, with their whole texts. Every text is scored whole, in segments of bounded size.

Cases: null texts and texts without letters are "und" with score 0 and rejected. A null lang teaches nothing, nor
does a null doc_id. Without any labelled text all are "und". Repeated rows are scored each on their own. No rows: no
rows. Other columns pass through; those of the names that are appended are replaced.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.session import frugal, plainly, with_fields
from glossmill.llm.wordhash import mix, ngrams
from glossmill.llm.workspace import Workspace

UNKNOWN = "und"
SEPARATOR = 32
_CHUNK = 1 << 19
_DISCOUNT = 0.75
#: Symbols of a segment.
SEGMENT = 128
#: The share of a language's own held segments that its limit keeps.
_QUANTILE = 0.99
#: Languages of fewer documents have none held out.
RARE = 50


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Letters, and the marks that scripts put to them: vowels of Indic ones, accents."""
    return _letters() | np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """Code points of letters and marks; runs of anything else are one separator."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(_symbols()[points], points, np.uint32(SEPARATOR))
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != SEPARATOR) | (out[:-1] != SEPARATOR)
    return out[keep]


def _hashes(seq: np.ndarray, n: int) -> np.ndarray:
    return ngrams(mix(seq.astype(np.uint64) + np.uint64(1)), n, salt=n)


def _hash_all(grams: list[str], n: int) -> np.ndarray:
    flat = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
    return np.array([], np.uint64) if not grams else _hashes(flat.reshape(-1), n)[::n]


@dataclass(frozen=True)
class Models:
    """keys[k], values[k]: sorted hashes of the n-grams of k + 1 symbols, and log-probabilities by language.
    contexts[k], falls[k]: hashes of contexts of k symbols, and logs of their weights of falling back.
    unseen: of a symbol that no language has. chance: bits of a uniform guess among a language's symbols. limits,
    spread: calibrated cross-entropy and deviation of a symbol's bits by language."""

    languages: tuple[str, ...]
    order: int
    keys: tuple[np.ndarray, ...]
    values: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    falls: tuple[np.ndarray, ...]
    unseen: np.ndarray
    chance: np.ndarray
    limits: np.ndarray | None = None
    spread: np.ndarray | None = None

    def log_probabilities(self, seq: np.ndarray) -> np.ndarray:
        """For each symbol from the order-th on, its log-probability after the ones before, by language."""
        n = len(seq) - self.order + 1
        out = np.zeros((n, len(self.languages)), np.float64)
        open_ = np.arange(n)
        for k in range(self.order, 0, -1):
            h = _hashes(seq, k)[self.order - k :][open_]
            at, hit = _find(self.keys[k - 1], h)
            out[open_[hit]] += self.values[k - 1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            if k > 1:
                c = _hashes(seq, k - 1)[self.order - k :][open_]
                at, hit = _find(self.contexts[k - 1], c)
                out[open_[hit]] += self.falls[k - 1][at[hit]]
        out[open_] += self.unseen
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text and language, bits per symbol; by text, the number of symbols and of letters."""
        return self.judged(texts)[:3]

    def judged(self, texts: list[str | None], each: Callable[[int, np.ndarray], None] | None = None) -> tuple[np.ndarray, ...]:
        """cross_entropies, and by text the bits per symbol with every segment by its best language, and by text and
        language the symbols of the segments that it is the best of. ``each`` gets a text's number and the bits of its
        segments of full size, by language."""
        pad = np.full(self.order - 1, SEPARATOR, np.uint32)
        sums, sizes, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        least, votes = np.zeros(len(texts)), np.zeros(sums.shape)
        waiting, owners, held = [], [], 0

        def score() -> None:
            bounds = np.cumsum([0, *(len(x) for x in waiting)])
            values = self.log_probabilities(np.concatenate(waiting))
            for row, a, b in zip(owners, bounds[:-1], bounds[1:], strict=True):
                part = values[a : b - self.order + 1]
                sums[row] += part.sum(axis=0)
                starts = np.arange(0, len(part), SEGMENT)
                segments = np.add.reduceat(part, starts, axis=0)
                best = segments.argmax(axis=1)
                least[row] += segments[np.arange(len(best)), best].sum()
                np.add.at(votes[row], best, np.minimum(SEGMENT, len(part) - starts))
                if each is not None:
                    each(row, -segments[: len(part) // SEGMENT] / SEGMENT / np.log(2))

        for row, text in enumerate(texts):
            tail = pad
            for at in range(0, len(text or ""), _CHUNK):
                new = symbols(text[at : at + _CHUNK])
                if at and len(new) and new[0] == SEPARATOR == tail[-1]:
                    new = new[1:]
                seq = np.concatenate((tail, new))
                if len(new):
                    waiting.append(seq)
                    owners.append(row)
                    held += len(seq)
                sizes[row] += len(new)
                letters[row] += int(_letters()[new].sum())
                tail = seq[len(seq) - self.order + 1 :]
                if held > _CHUNK:
                    score()
                    waiting, owners, held = [], [], 0
        if held:
            score()
        some = np.maximum(sizes, 1)
        return -sums / some[:, None] / np.log(2), sizes, letters, -least / some / np.log(2), votes


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit(counts: dict[str, dict[str, int]], order: int) -> Models:
    """Interpolated Kneser-Ney from the counts of n-grams of ``order`` symbols by language: the highest order by
    counts, each lower one by the number of different symbols that its n-grams follow."""
    languages = tuple(sorted(counts))
    alphabet = {c for grams in counts.values() for g in grams for c in g}
    probability: list[dict[str, np.ndarray]] = [{} for _ in range(order)]
    fall: list[dict[str, np.ndarray]] = [{} for _ in range(order)]
    levels = {}
    for language, grams in counts.items():
        level = {order: grams}
        for k in range(order - 1, 0, -1):
            level[k] = Counter(g[1:] for g in level[k + 1])
        levels[language] = level
    uniform = 1 / (len(alphabet) + 1)
    for k in range(1, order + 1):
        union = sorted({g for x in levels.values() for g in x[k]})
        for n, language in enumerate(languages):
            seen = levels[language][k]
            total, kinds = defaultdict(int), defaultdict(int)
            for g, c in seen.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            for h, c in total.items():
                fall[k - 1].setdefault(h, np.ones(len(languages)))[n] = _DISCOUNT * kinds[h] / c
            for g in union:
                h = g[:-1]
                lower = probability[k - 2][g[1:]][n] if k > 1 and g[1:] in probability[k - 2] else uniform
                t = total.get(h, 0)
                p = lower if not t else max(seen.get(g, 0) - _DISCOUNT, 0) / t + _DISCOUNT * kinds[h] / t * lower
                probability[k - 1].setdefault(g, np.zeros(len(languages)))[n] = p
    keys, values, contexts, falls = [], [], [], []
    for k in range(order):
        for table, size, hashes, logs in ((probability[k], k + 1, keys, values), (fall[k], k, contexts, falls)):
            h = _hash_all(list(table), size) if size else np.zeros(1, np.uint64)
            v = np.log(np.array(list(table.values())).reshape(len(table), len(languages)))
            s = np.argsort(h)
            hashes.append(h[s])
            logs.append(v[s] if len(table) else v)
    unseen = np.log(uniform) + (falls[0][0] if len(falls[0]) else 0)
    chance = np.log2([len(levels[x][1]) + 1 for x in languages])
    return Models(languages, order, tuple(keys), tuple(values), tuple(contexts), tuple(falls), unseen, chance)


def train(labelled: DataFrame, order: int = 4, sample: int = 1000) -> Models | None:
    """From (doc_id, text, lang). A fifth of the sample sets the thresholds of rejection, the rest the models. Languages
    of fewer than RARE documents have their models from all of them, and no calibrated threshold."""
    rows = labelled.where("doc_id is not null and text is not null and lang is not null")
    # As many rows as there are different labels; written, so Spark knows whether they are few enough to broadcast.
    bound = F.floor(F.least(F.lit(1.0), F.lit(sample) / F.count("*")) * (1 << 30)).alias("bound")
    sizes = Workspace(labelled.sparkSession, "languages").cut(rows.groupBy("lang").agg(bound, (F.count("*") >= RARE).alias("common")), "sizes")
    if sizes.isEmpty():
        return None
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    taken = rows.join(sizes, "lang").select("text", "lang", "common", place.alias("place"), "bound").where("place < bound")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        pad = " " * (order - 1)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = pad + symbols(text.as_py()).tobytes().decode("utf-32-le", "surrogatepass")
                seen[lang].update(s[n : n + order] for n in range(len(s) - order + 1))
        for lang, grams in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    held = (F.pmod(F.xxhash64(F.lit(1), "place"), F.lit(5)) == 0) & F.col("common")
    found = taken.where(~held).select("text", "lang").mapInArrow(frugal(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, gram, n in zip(*(found.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        counts[lang][gram] = n
    if not counts:
        return None
    models = fit(counts, order)
    # A common language whose documents were all held has no model.
    return _calibrated(models, taken.where(held & F.col("lang").isin(*models.languages)).select("text", "lang"))


def _calibrated(models: Models, held: DataFrame) -> Models:
    """limits: the bits per symbol that all but a hundredth of the held segments of a language stay below, of those
    that its own model predicts best; never more than chance, and chance for a language without such segments. spread:
    the deviation of a symbol's bits that the deviation of the segments shows, by which short texts have more room."""
    names = {x: n for n, x in enumerate(models.languages)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, seen = [names[x] for x in batch.column(1).to_pylist()], Counter()

            def each(row: int, bits: np.ndarray) -> None:
                mine = bits[bits.argmin(axis=1) == own[row], own[row]]
                seen.update((own[row], x) for x in np.ceil(mine * 64).astype(np.int64).tolist())

            models.judged(batch.column(0).to_pylist(), each)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], ["own", "bits", "n"])

    # A histogram by 64ths of a bit comes back.
    found = defaultdict(list)
    for r in held.mapInArrow(frugal(measure), "own long, bits long, n long").groupBy("own", "bits").agg(F.sum("n").alias("n")).collect():
        found[r["own"]].append((r["bits"] / 64, r["n"]))
    limits, spread = models.chance.copy(), np.full(len(names), np.nan)
    for n, histogram in found.items():
        bits, times = (np.array(x) for x in zip(*sorted(histogram), strict=True))
        limits[n] = min(limits[n], bits[np.searchsorted(np.cumsum(times), _QUANTILE * times.sum())])
        spread[n] = np.sqrt(np.average((bits - np.average(bits, weights=times)) ** 2, weights=times) * SEGMENT)
    spread = np.where(np.isnan(spread), np.nanmax(spread) if len(found) else models.chance, spread)
    return Models(**{**vars(models), "limits": limits, "spread": spread})


def identify(documents: DataFrame, models: Models | None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Appends under ``names`` the language, its score (0 to 1: the weight of the best language, texts counting as 64
    symbols at most) and whether it is rejected (no language, or segments whose cross-entropies are above their languages'
    limits on average)."""
    others = [c for c in documents.columns if c.lower() not in names]
    rows = plainly(documents, others)
    columns = rows.columns
    sent, at = documents.sparkSession.sparkContext.broadcast(models), others.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            texts = batch.column(at)
            for a in range(0, batch.num_rows, 64):
                part = texts.slice(a, 64).to_pylist()
                if models is None:
                    langs += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    rejected += [True] * len(part)
                    continue
                bits, sizes, letters, least, votes = models.judged(part)
                best = bits.argmin(axis=1)
                weight = (64.0 * sizes / (sizes + 64.0))[:, None] * (bits - bits.min(axis=1)[:, None])
                top = 1 / np.exp2(-weight).sum(axis=1)
                some = np.maximum(sizes, 1)
                over = least > votes @ models.limits / some + 3 * (votes @ models.spread / some) / np.sqrt(some)
                none = letters == 0
                langs += [UNKNOWN if n else models.languages[b] for n, b in zip(none, best, strict=True)]
                scores += np.where(none, 0.0, np.round(top, 6)).tolist()
                rejected += (over | none).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*columns, "lang", "score", "rejected"])

    return rows.mapInArrow(frugal(read), with_fields(rows, lang="string", score="double", rejected="boolean")).toDF(*others, *names)


def held_out(doc_id: Column) -> Column:
    """The third of documents that models are not trained on; a null doc_id isn't in it (and teaches nothing)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
