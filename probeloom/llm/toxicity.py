"""Toxicity scores from a learned lexicon, misspellings included.

The lexicon (words, and word beginnings for inflected terms) is counted in Spark
over labelled training rows: every term whose share of toxic rows is significant. A
document's words are matched by Levenshtein automata: the states of the word's
automaton are bit masks, stepped along the tries of words and of beginnings, so
branches that no spelling within the limit can reach are never entered. A spelling
counts as far as training rows do not show it to be another word. Each match is weighed by a window of words around it: quotation marks and
reporting words, and words that training rows tie to quotation rather than abuse.
A small logistic model turns the sums into a score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.llm.common import table
from probeloom.llm.quality import fold, sigmoid
from probeloom.session import bounded_rows

FOLDS, HELD_OUT = 3, 1
TOXIC = 0.7
# Labelled training rows of each class that the model is fitted on, taken in
# order of a hash of their id.
SAMPLE = 4000
# Terms have a log odds ratio of LEAST_ODDS or more, and a share of toxic rows that is
# significant at this false discovery rate among all words and beginnings.
LEAST_ODDS, FALSE_RATE = 2.5, 0.01
# Terms that the driver and every task can hold; more are refused, never cut.
MAX_TERMS = 500_000
STEMS = range(4, 9)
WINDOW = 4
REMEMBERED = 300_000
QUOTES = frozenset("\"“”„«»‘’'`‹›")
# Words that report speech or name a word rather than use it.
REPORTING = frozenset("said says called calls word words term terms quote quoted quotes wrote written "
                      "meaning means definition slur insult phrase".split())
WIDTH = 6
# What a misspelling counts that training rows do not hold.
UNSEEN = 0.9


def allowed(term: str) -> int:
    """Spelling errors that a term may have. With three letters or fewer, an error makes another word."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


def short(term: str) -> bool:
    """Terms so short that a spelling error often makes another word."""
    return len(term) < 5


def rank(match: tuple[str, int]) -> int:
    """Fewest errors first, spellings of short terms last."""
    entry, errors = match
    return 3 if errors and short(entry) else errors


def grown(terms: list[str]) -> dict:
    """Trie of terms. The key '' marks an end."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term
    return root


class Lexicon:
    """Words and stems, found by the pieces that a spelling leaves whole.

    Of n + 1 pieces of an entry one is whole in any spelling with n errors, at most n
    places from its own. Tries are walked of the entries with such a piece only.
    Entries in ``exact`` are matched without errors only.
    """

    def __init__(self, words: list[str], stems: list[str], exact: frozenset = frozenset()):
        self.words, self.stems = frozenset(words), frozenset(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        self.limits = {t: 0 if t in exact else allowed(t) for t in (*words, *stems)}
        # (begins, entry) by place and piece.
        self.pieces: dict[tuple[int, str], list[tuple[bool, str]]] = {}
        for begins, terms in ((False, sorted(words)), (True, sorted(stems))):
            for t in terms:
                n = self.limits[t]
                cuts = [len(t) * k // (n + 1) for k in range(n + 2)] if n else []
                for i, j in zip(cuts, cuts[1:]):
                    for at in range(max(0, i - n), i + n + 1) if i else [0]:
                        self.pieces.setdefault((at, t[i:j]), []).append((begins, t))
        self.spans = sorted({(at, at + len(piece)) for at, piece in self.pieces})

    def match(self, word: str) -> tuple[str, int] | None:
        """The lexicon entry and its number of errors: the first by ``rank``, words before stems."""
        if word in self.words:
            return word, 0
        for size in self.stem_sizes:
            if word[:size] in self.stems:
                return word[:size], 0
        near = {c for i, j in self.spans if j <= len(word) for c in self.pieces.get((i, word[i:j]), ())}
        if not near:
            return None
        words = grown([t for begins, t in near if not begins and abs(len(t) - len(word)) <= self.limits[t]])
        stems = grown([t for begins, t in near if begins])
        found = [m for m in (self.walk(words, word, False), self.walk(stems, word, True)) if m]
        return min(found, key=rank) if found else None

    def walk(self, root: dict, word: str, begins: bool) -> tuple[str, int] | None:
        """Best entry of a trie for the whole word, or for some beginning of it."""
        if not root:
            return None
        at: Counter = Counter()
        for i, c in enumerate(word):
            at[c] |= 1 << i
        end, best = 1 << len(word), None
        ends = 2 * end - 1 if begins else end
        # Masks of the positions reached in the word after 0, 1 and 2 errors.
        todo = [(root, (1, 3, 7))]
        while todo:
            node, (r0, r1, r2) = todo.pop()
            for c, below in node.items():
                if c == "":
                    errors = 0 if r0 & ends else 1 if r1 & ends else 2 if r2 & ends else 3
                    if errors <= self.limits[below]:
                        m = below, errors
                        if best is None or (rank(m), below) < (rank(best), best[0]):
                            best = m
                    continue
                mask = at.get(c, 0)
                s0 = (r0 & mask) << 1
                s1 = (r1 & mask) << 1 | r0 | (r0 | s0) << 1
                s2 = (r2 & mask) << 1 | r1 | (r1 | s1) << 1
                if (s0 | s1 | s2) & (2 * end - 1):
                    todo.append((below, (s0, s1, s2)))
        return best


def words_of(chunk: str) -> list[str]:
    """Letter and digit runs of a chunk, and the chunk without the marks inside it."""
    runs, run = [], []
    for c in chunk.lower():
        if c.isalnum():
            run.append(c)
        elif run:
            runs.append("".join(run))
            run = []
    if run:
        runs.append("".join(run))
    return [*runs, "".join(runs)] if len(runs) > 1 else runs


class Matches(dict):
    """Lexicon match of a white-space-free chunk, found when first met."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, chunk):
        if len(self) >= REMEMBERED:
            self.clear()
        found = [m for m in map(self.lexicon.match, words_of(chunk)) if m]
        best = self[chunk] = min(found, key=rank) if found else None
        return best


MATCHES: dict[tuple, Matches] = {}


def matches(words: tuple, stems: tuple, exact: frozenset = frozenset()) -> Matches:
    key = words, stems, exact
    if key not in MATCHES:
        MATCHES.clear()
        MATCHES[key] = Matches(Lexicon(list(words), list(stems), exact))
    return MATCHES[key]


def hits(text: str, known: Matches) -> list[tuple[str, int, bool, list[str]]]:
    """(entry, errors, quoted, words around) of each match, in order of the text."""
    chunks = text.split()
    there = {c for c in set(chunks) if known[c]}
    found = []
    if there:
        for i, c in enumerate(chunks):
            if c in there:
                around = chunks[max(0, i - WINDOW):i] + chunks[i + 1:i + 1 + WINDOW]
                near = [w for x in around for w in words_of(x)]
                marked = c[0] in QUOTES and c.rstrip(".,;:!?")[-1:] in QUOTES
                opened = any(x[0] in QUOTES for x in chunks[max(0, i - WINDOW):i + 1])
                closed = any(x.rstrip(".,;:!?")[-1:] in QUOTES for x in chunks[i:i + 1 + WINDOW])
                quoted = marked or (opened and closed) or not REPORTING.isdisjoint(near)
                found.append((*known[c], quoted, near))
    return found


def weight(entry: str, errors: int, spelled: dict[str, float]) -> float:
    """What a match counts: less with errors, least for errors in short terms."""
    if not errors:
        return 1.0
    return (1 - errors / (len(entry) + 1)) * spelled.get(entry, UNSEEN) / (2 if short(entry) else 1)


def summary(found: list, context: dict[str, float], spelled: dict[str, float] | None = None) -> list[float]:
    """Bias, abuse, its logarithm, the misspelled part of it, quoted abuse, context score."""
    mass = odd = quoted = lean = total = 0.0
    for entry, errors, q, near in found:
        own = weight(entry, errors, spelled or {})
        total += own
        quoted += own if q else 0.0
        mass += own if not q else 0.0
        odd += own if not q and errors else 0.0
        lean += own * sum(context.get(w, 0.0) for w in near) / max(1, len(near))
    if not total:
        return [1.0] + [0.0] * (WIDTH - 1)
    return [1.0, min(mass, 2.0), float(np.log1p(mass)), min(odd, 2.0), min(quoted, 2.0), lean / total]


def fingerprint(text: str) -> int:
    """Least hash of the five-word runs: near copies mostly share it, other texts do not."""
    words = text.split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of at most SAMPLE labelled training rows of each class."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    training = marks.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    order = F.xxhash64("doc_id")
    chosen = training.filter("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE).unionByName(
        training.filter("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or "") for t in texts.to_pylist()], pa.int64())

    # One row of a group of copies, so that its words do not pass for terms.
    return rows.withColumn("print", prints("text")).dropDuplicates(["toxic", "print"]).select("doc_id", "text", "toxic")


def log_bound(bad: int, good: int, share: float) -> float:
    """Logarithm of Chernoff's bound for a split of rows as uneven as this, were a ``share`` of all bad."""
    n = bad + good
    return -sum(x * float(np.log(x / (n * s))) for x, s in ((bad, share), (good, 1 - share)) if x)


def significant_terms(sample: DataFrame, bad: int, good: int) -> list:
    """Words and stems of toxic rows, with their numbers of toxic and other rows.

    Benjamini and Hochberg's choice among all words and stems, of those with odds of LEAST_ODDS.
    """
    if not bad:
        return []

    @F.arrow_udf("array<string>")
    def terms(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            words = {w for c in set((t or "").split()) for w in words_of(c)}
            out.append([*("w" + w for w in words), *{"s" + w[:k] for w in words for k in STEMS if len(w) > k}])
        return pa.array(out, pa.list_(pa.string()))

    share, n = bad / (bad + good), F.col("bad") + F.col("good")
    log_p = -F.col("bad") * F.log(F.col("bad") / (n * share))
    if good:
        log_p = log_p - F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    counted = sample.select("toxic", F.explode(terms("text")).alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    ).withColumn("log_p", F.when(F.col("bad") > n * share, log_p).otherwise(0.0)).persist()
    try:
        tested = kept = counted.count()
        # Counting below the level of the last count falls to the last rank that holds its level.
        while kept:
            level = float(np.log(FALSE_RATE * kept / tested))
            found = counted.filter(F.col("log_p") <= level)
            last, kept = kept, found.count()
            if kept == last:
                return bounded_rows(found.filter(odds >= LEAST_ODDS).select("term", "bad", "good"), MAX_TERMS, "terms")
        return []
    finally:
        counted.unpersist()


def choose(terms: list) -> tuple[tuple, tuple]:
    """Words and stems of the lexicon. A stem is added where no single word holds most of its rows."""
    rows = {r["term"]: r["bad"] for r in terms}
    strong = list(rows)
    longest: Counter = Counter()
    for t in strong:
        if t[0] == "w":
            for k in STEMS:
                longest[t[1:1 + k]] = max(longest[t[1:1 + k]], rows[t])
    stems: list[str] = []
    for t in sorted(strong, key=lambda t: (len(t), t)):
        if t[0] == "s" and longest[t[1:]] < 0.8 * rows[t] and not any(t[1:].startswith(s) for s in stems):
            stems.append(t[1:])
    return tuple(sorted(t[1:] for t in strong if t[0] == "w")), tuple(sorted(stems))


def spelling_weights(listed: list) -> dict[str, float]:
    """What the misspellings of an entry count, 0 to 1, of those that training rows hold.

    Rows that are not toxic count twice and in the proportion of the classes: an
    entry near to common words loses its spellings, and no other.
    """
    sizes = [sum(1 for y, _ in listed if y == side) for side in (0, 1)]
    least = min(sizes)
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for y, found in listed:
        seen[y].update({h[0] for h in found if h[1] and not h[2]})
    out = {}
    for entry in seen[0].keys() | seen[1].keys():
        good, bad = (seen[side][entry] * least / sizes[side] if sizes[side] else 0.0 for side in (0, 1))
        out[entry] = float(min(1.0, max(0.0, (bad - 2 * good + 9) / (bad + good + 10))))
    return out


def context_weights(near: tuple[Counter, Counter], hit: list[int]) -> dict[str, float]:
    """Log odds of abuse of the words around matches, where the split of their rows is significant.

    ``near`` counts rows by word and ``hit`` all rows with matches, not toxic and toxic.
    Only rows that hold terms and are not toxic tell quotation from abuse.
    """
    if not all(hit):
        return {}
    share = hit[1] / sum(hit)
    bounds = {w: log_bound(near[1][w], near[0][w], share) for w in near[0].keys() | near[1].keys()}
    ordered = sorted(bounds, key=lambda w: (bounds[w], w))
    last = max((i for i, w in enumerate(ordered, 1) if bounds[w] <= np.log(FALSE_RATE * i / len(ordered))), default=0)
    return {
        w: float(np.log((near[1][w] + 1) / (hit[1] + 3)) - np.log((near[0][w] + 1) / (hit[0] + 3))) for w in ordered[:last]
    }


def logistic(x: np.ndarray, y: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Newton steps with a ridge towards ``centre``, halved until the loss falls."""

    def loss(w):
        g = x @ w
        return np.logaddexp(0, g).sum() - y @ g + ((w - centre) ** 2).sum() / 2

    w = centre.copy()
    for _ in range(50):
        p = sigmoid(x @ w)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        step = np.linalg.solve(curve, x.T @ (p - y) + (w - centre))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-6:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


# What a feature weighs before any row speaks: quoting takes most of the abuse back.
CENTRE = np.array([-3.0, 3.0, 1.0, -1.0, 0.5, 0.5])


def train(docs: DataFrame, labels: DataFrame) -> tuple[tuple, tuple, dict, dict, np.ndarray]:
    """Lexicon, weights of spellings and context, logistic weights. Without labelled rows the lexicon is empty."""
    sample = sampled(docs, labels).persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        words, stems = choose(significant_terms(sample, bad, good))

        def run(batches):
            known = matches(words, stems)
            for batch in batches:
                found = [hits(t or "", known) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column(1), pa.array([[h[0] for h in f] for f in found], pa.list_(pa.string())),
                    pa.array([[h[1] for h in f] for f in found], pa.list_(pa.int32())),
                    pa.array([[h[2] for h in f] for f in found], pa.list_(pa.bool_())),
                    pa.array([[h[3] for h in f] for f in found], pa.list_(pa.list_(pa.string()))),
                ], ["toxic", "entry", "errors", "quoted", "near"])

        schema = "toxic int, entry array<string>, errors array<int>, quoted array<boolean>, near array<array<string>>"
        rows = bounded_rows(
            sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, schema), 4 * SAMPLE, "sample"
        )
    finally:
        sample.unpersist()
    listed = [(r["toxic"], list(zip(r["entry"], r["errors"], r["quoted"], r["near"]))) for r in rows]
    spelled = spelling_weights(listed)
    listed = [(y, [h for h in found if weight(h[0], h[1], spelled)]) for y, found in listed]
    near: tuple[Counter, Counter] = Counter(), Counter()
    for y, found in listed:
        near[y].update({w for h in found for w in h[3]})
    context = context_weights(near, [sum(1 for y, f in listed if f and y == side) for side in (0, 1)])
    if not listed:
        return words, stems, spelled, context, CENTRE
    x = np.array([summary(f, context, spelled) for _, f in listed])
    w = logistic(x, np.array([y for y, _ in listed], float), CENTRE)
    return words, stems, spelled, context, w


def score_with(model: tuple):
    """Column function from text to score."""
    words, stems, spelled, context, w = model
    exact = frozenset(t for t, x in spelled.items() if not x)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known = matches(words, stems, exact)
        rows = [summary(hits(t.as_py() or "", known), context, spelled) for t in texts]
        return pa.array(sigmoid(np.array(rows).reshape(-1, WIDTH) @ w), pa.float64())

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Texts that are null, empty or free of terms get the score of the bias. Rows
    with a null id are scored and not held out; repeated rows are scored each; an
    empty table gives no rows. Other columns are ignored.
    """
    score = score_with(train(docs, labels))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    )
