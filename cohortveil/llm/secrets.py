"""Secret scans: fixed patterns, then password guess costs in credential contexts.

The fixed patterns find assignments, access ids and long hexadecimal runs.
Beside them, values that stand in a credential context (the assignments' names
and more, also at the end of longer names) are judged by how many guesses they
would cost: a dynamic programme finds the cheapest segmentation of the value
into dictionary words, dates, repeats, keyboard walks and brute-force spans.
Values that cost at least 10**`min_log10` guesses are secrets, whatever their
characters.  The dictionary is `COMMON` and the corpus's own most frequent
words, ranked by how many documents they are in.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import as_text, document_texts, map_texts

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 10.0

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMED = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
CONTEXT_NAMES = ("password", "passwd", "secret", "token", "api_?key", "pwd", "pass", "passphrase", "passcode", "pin", "auth", "credential", "credentials", "login", "private_key", "access_key", "client_key", "bearer")
#: A name, which may end a longer one (DB_PWD), and what comes before its value.
CONTEXT = re.compile(r"""(?:%s)["']?\x20*[:=]\x20*(["']?)(?=\S)""" % "|".join(sorted(CONTEXT_NAMES, key=len, reverse=True)), re.ASCII | re.IGNORECASE)
CONTEXT_HINT = re.compile(r"pwd|pass|pin|auth|credential|login|_key|apikey|bearer|secret|token", re.ASCII | re.IGNORECASE)
BLANK = re.compile(r"\s|\Z", re.ASCII)
#: What closes a sentence, list or bracket after a value is not part of it.
CLOSING = """.,;:)]}>|"'"""

#: Fixed: common parts of guessable passwords, commonest first.
COMMON = """password qwerty dragon monkey letmein welcome login admin master hello freedom whatever shadow sunshine princess
football baseball superman batman iloveyou trustno secret summer winter spring autumn monday friday january february march april
june july august september october november december test guest root user default changeme access pass love money the and for you
with this that from have are not your example none null true false sample value here insert""".split()
#: Words of the corpus that the dictionary takes at most, in how many documents they are at least, and their letters.
MOST_WORDS, FEWEST, LETTERS = 10_000, 50, (3, 20)
LEET = str.maketrans("@4301$5!7", "aaeolssit")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEAR = {(a, b) for row in ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
NEAR |= {(a, b) for up, low in zip(ROWS, ROWS[1:], strict=False) for x, y in zip(up, low, strict=False) for a, b in ((x, y), (y, x))}
YEAR, SEPARATOR = r"(?:19|20)\d\d", r"[-/._]?"
DAYS, MONTHS = (r"(?:0[1-9]|[12]\d|3[01])", r"[1-9]"), (r"(?:0[1-9]|1[0-2])", r"[1-9]")
#: Dates by their shape; each is looked for at every place, so all that overlap are found.
DATES = [re.compile(f"(?=({x}))", re.ASCII) for x in (YEAR + SEPARATOR + MONTHS[0] + SEPARATOR + DAYS[0], *(d + SEPARATOR + m + SEPARATOR + YEAR for d in DAYS for m in MONTHS), YEAR)]


def ranked(words: Sequence[str] = ()) -> dict[str, int]:
    """The dictionary: each word's rank, COMMON before the corpus's."""
    out: dict[str, int] = {}
    for word in (*COMMON, *words):
        out.setdefault(word, len(out) + 1)
    return out


def corpus_words(docs: DataFrame, most: int = MOST_WORDS, fewest: int = FEWEST) -> list[str]:
    """The runs of letters a-z that are in the most documents, at least `fewest`, commonest first, ties in order.

    Counted over all of all texts, with a partial aggregate; the driver gets `most` words.
    """
    low, high = LETTERS
    word = F.explode(F.array_distinct(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+"))).alias("word")
    held = docs.select(word).where(F.length("word").between(low, high)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)
    return [r["word"] for r in held.orderBy(F.desc("n"), "word").limit(most).collect()]


RANKS = ranked()


def alphabet(text: str) -> int:
    """How many characters a brute-force guess has to try at each place."""
    size = 26 * any("a" <= c <= "z" for c in text) + 26 * any("A" <= c <= "Z" for c in text)
    size += 10 * any("0" <= c <= "9" for c in text) + 33 * any(not c.isalnum() for c in text) + 100 * any(ord(c) > 127 for c in text)
    return max(size, 10)


class Stretches:
    """Repeats and keyboard walks from each place of a value, taken in order, at their full lengths.

    A repeat's unit has at most `most` characters.  Of the starts in one
    maximal stretch, only those lead on that an earlier start (of the same
    phase) doesn't beat at every end: a longer repeat or walk costs a logarithm
    more, so that is settled at the shortest end.
    """

    def __init__(self, value: str, low: str, most: int, brute: float):
        self.value, self.low, self.most, self.brute = value, low, most, brute
        self.differs = [-1] * (most + 1)  # by unit size: the first place from here on that differs from the one a unit later
        self.starts: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(most + 1)]
        self.walk_end, self.walks = 0, []

    def leads(self, i: int, cost: float) -> Iterator[tuple[int, float]]:
        """Ends and costs of what starts at i, which costs `cost` so far."""
        n, value = len(self.value), self.value
        if self.walk_end <= i:
            j = i + 1
            while j < n and (self.low[j - 1], self.low[j]) in NEAR:
                j += 1
            self.walk_end, self.walks = j, []
        if self.walk_end - i >= 3 and all(cost < before + math.log10((3 + i - s) / 3) for s, before in self.walks):
            self.walks.append((i, cost))
            for k in range(i + 3, self.walk_end + 1):
                yield k, cost + math.log10(40.0 * (k - i)) + 0.3
        for size in range(1, min(self.most, (n - i) // 2) + 1):
            if self.differs[size] < i:
                j = i
                while j + size < n and value[j] == value[j + size]:
                    j += 1
                self.differs[size], self.starts[size] = j, {}
            units = (self.differs[size] - i) // size + 1
            # A unit that repeats a smaller one costs more than that does.
            if units < 2 or any(size % d == 0 and self.differs[d] - i >= size - d for d in range(1, size // 2 + 1)):
                continue
            held = self.starts[size].setdefault(i % size, [])
            if all(cost < before + math.log10(1 + (i - s) // size / 2) for s, before in held):
                held.append((i, cost))
                for k in range(max(2, -(-3 // size)), units + 1):
                    yield i + k * size, cost + size * self.brute + math.log10(k) + 0.3


def guess_cost(value: str, ranks: dict[str, int] | None = None, enough: float = math.inf) -> float:
    """log10 of the guesses for `value`: the cheapest way to put it together.

    best[k] is the least cost of the first k characters; brute force for one
    more character, and every pattern that starts at k, lead on.  Each pattern
    segment costs a factor of two for being one of the several patterns.
    Repeats and walks count at their full length, whatever it is.  A repeat
    costs its unit by brute force at least, so units that cost `enough` on their
    own are left out; and once every way through costs `enough`, that is given
    back, so most of a long value that is hard to guess isn't read.  Without
    `enough` units have any length, which takes the square of the value's.  ''
    costs 0.
    """
    ranks, n = RANKS if ranks is None else ranks, len(value)
    longest, brute, best = max(map(len, ranks), default=0), math.log10(alphabet(value)), [0.0] + [math.inf] * n
    low = value.lower()
    if len(low) != n:  # a few letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    stretches = Stretches(value, low, n // 2 if enough == math.inf else min(n // 2, int(enough / brute) + 1), brute)
    furthest = 0  # the last place so far that costs less than enough
    for i in range(n):
        if i > furthest:
            return enough
        if best[i] >= enough:
            continue
        ways = [(i + 1, best[i] + brute)]
        if "0" <= value[i] <= "9":
            for k, pattern in enumerate(DATES):
                if m := pattern.match(value, i):
                    ways.append((m.end(1), best[i] + math.log10(130.0 if k == len(DATES) - 1 else 365.0 * 130)))
        for j in range(i + 3, min(n, i + longest) + 1):
            if rank := ranks.get(low[i:j]) or ranks.get(plain[i:j]):
                ways.append((j, best[i] + math.log10(rank + 1) + 0.3 * (1 + (value[i:j] != low[i:j]) + (low[i:j] != plain[i:j]))))
        for end, cost in chain(ways, stretches.leads(i, best[i])):
            if cost < best[end]:
                best[end] = cost
                if cost < enough and end > furthest:
                    furthest = end
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches that are long enough."""
    out = []
    if NAMED.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, base: list[tuple[int, int, int]], min_log10: float = MIN_LOG10, ranks: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """Spans of credential values that are hard to guess and reach beyond every base span.

    A value goes on to the next blank, or to the quote that closes the one
    before it; closing punctuation at a blank isn't part of it.  A value inside
    one that was found before is left out.
    """
    if not CONTEXT_HINT.search(text):
        return []
    out: list[tuple[int, int, int]] = []
    blank, stop, k, covered = -1, 0, 0, 0
    for m in CONTEXT.finditer(text):
        a = m.end()
        if a > blank:
            blank = BLANK.search(text, a).start()
            stop = a + len(text[a:blank].rstrip(CLOSING))
        b = text.find(m[1], a, blank) if m[1] else -1
        b = stop if b < 0 else b
        while k < len(base) and base[k][0] <= a:
            covered, k = max(covered, base[k][2]), k + 1
        if a >= b or b <= covered or out and b <= out[-1][2]:
            continue
        if guess_cost(text[a:b], ranks, min_log10) >= min_log10:
            out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, min_log10: float = MIN_LOG10, with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Secrets of every whole text.

    Returns doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 (of the
    base spans as kind:start:end, joined by commas), spans (all spans, joined
    likewise; a guess that reaches beyond a base span overlaps it) and, with `with_text`, clean_text: each secret replaced by
    [SECRET].  Offsets count code points; ends are exclusive.  Columns named in
    `carry` come along, last.

    A null text counts as empty and has no spans: '' and the digest of ''.
    The dictionary comes from all texts; with it, rows are judged one by one,
    so repeated rows and null ids are judged alike, and clashing other columns
    change nothing.  No rows give no rows.
    """
    ranks = ranked(corpus_words(document_texts(docs)))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string" + ", clean_text string" * with_text

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: list[list[int]] = [[], [], [], []]
            hashes, spans, clean = [], [], []
            for text in as_text(batch.column("text")):
                base = base_spans(text)
                more = guessed_spans(text, base, min_log10, ranks)
                every = sorted(base + more) if more else base
                for k, column in enumerate(counts):
                    column.append(sum(s[1] == k for s in every))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                if with_text:
                    clean.append(masked(text, every) if every else text)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
            if with_text:
                columns.append(pa.array(clean, pa.string()))
                names.append("clean_text")
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    return map_texts(docs, carry, work, schema)
