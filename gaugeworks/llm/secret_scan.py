"""Secret scans: patterns, and character Markov models of random strings and identifiers (operator 3).

Three kinds come from patterns. A fourth, ``random``, comes from two first-order character models, one
trained on random strings and one on ordinary identifiers: a candidate whose log-likelihood ratio per
character exceeds a threshold looks generated. Candidates are runs and all their stretches between
separators, so a name or a path before a value does not hide it, and ordinary parts between two values stay. What a pattern's span already holds is
not reported again; what it leaves of a run is.

Scale: a map over documents with no shuffle; the two models are a table of 70 x 70 numbers.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import id_and_text, per_batch, small_batches

KINDS = ("assign", "access", "hex", "random")
ALPHABET = string.ascii_letters + string.digits + "+/_=-."
#: Length from which a run of the alphabet is a candidate, and the ratio per character it must exceed.
CANDIDATE, THRESHOLD = 20, 0.75
#: Log-likelihood ratio, in sum, at or under which neighbouring parts end a stretch: a part of a random string is
#: that far on the other side with a chance of exp(-5) at most.
ORDINARY = -5.0
_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE},}}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Words of which ordinary identifiers are made up for training.
_PARTS = """account action active address array async back base batch block body buffer build button byte cache call
channel char check child class clear client close cluster code color column command commit config connect content
context control copy count create current data date debug default delete device dialog domain driver edit element
empty enable end engine entry error event example execute export field file filter first flag folder format frame
function global group handle hash header height host image import index info init input insert item job key label
last layer length level library limit line link list load local lock log manager map mask match memory merge message
method mode model module mouse move name network new next node number object offset open option order output owner
page panel parent parse part partition path pattern pending pixel point pool position prefix print process profile
project property query queue random range read record reference region register release remove render report request
reset resource response result return row run save schema scope screen search select send sequence server service
session shape share size sort source stack start state status store stream string style suffix switch system table
target task template test text thread time title total trace tree type update user value vector version view watch
width window word worker write the and of ing tion er re nt th an in on es ed st ent ment que les der die und""".split()


def _pattern(rng: random.Random) -> str:
    """A string that a person or a program makes without chance: a ruler, a stretch of an alphabet, a date, a version, a path."""
    both = "".join(map("".join, zip(string.ascii_uppercase, string.ascii_lowercase, strict=True)))
    order = rng.choice((string.ascii_lowercase, string.ascii_uppercase, string.digits, string.ascii_letters + string.digits, both, both.swapcase(), "qwertyuiopasdfghjklzxcvbnm", "QWERTYUIOPASDFGHJKLZXCVBNM"))
    kind = rng.randrange(6)
    if kind == 0:
        return rng.choice(ALPHABET) * rng.randint(20, 80)
    if kind == 1:
        at = rng.randrange(len(order))
        cycle = (order[at:] + order[:at]) * 3
        return (cycle if rng.random() < 0.7 else cycle[::-1])[: rng.randint(20, 70)]
    if kind == 2:
        return "".join(rng.choices("-=_+/.", k=rng.randint(1, 4))) * 20
    day = f"{rng.randint(1970, 2040)}{{0}}{rng.randint(1, 12):02d}{{0}}{rng.randint(1, 28):02d}".format(rng.choice(("-", "", "_", "/")))
    clock = f"{rng.randint(0, 23):02d}{rng.choice(('-', '', '.', '_'))}{rng.randint(0, 59):02d}{rng.randint(0, 59):02d}"
    if kind == 3:
        return rng.choice(("-", "_", "T", "/")).join((day, clock, day))
    if kind == 4:
        return rng.choice(("-", "_", ".")).join(str(rng.randint(0, 10 ** rng.randint(1, 6))) for _ in range(6))
    return "/".join((*rng.choices(_PARTS, k=3), day, f"{rng.choice(_PARTS)}_{rng.choice(_PARTS)}.{rng.choice(('txt', 'csv', 'json', 'html', 'py', 'log'))}"))


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """n random strings (label 1), n ordinary identifiers and n // 2 patterns (label 0), always the same for a seed."""
    rng = random.Random(seed)
    sets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_")
    out = [("".join(rng.choices(rng.choice(sets), k=rng.randint(20, 64))), 1) for _ in range(n)]
    for _ in range(n):
        parts = rng.choices(_PARTS, k=rng.randint(2, 6))
        kind = rng.randrange(6)
        joined = ("".join(p.title() for p in parts), "_".join(parts), "-".join(parts), "/".join(parts), "_".join(parts).upper(), "".join(parts))[kind]
        out.append((joined + (str(rng.randint(0, 2030)) if rng.random() < 0.2 else ""), 0))
    return out + [(_pattern(rng), 0) for _ in range(n // 2)]


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratios of character pairs: random strings against identifiers."""

    first: np.ndarray
    step: np.ndarray

    def ratio(self, s: str) -> float:
        """The mean log-likelihood ratio per character; characters outside the alphabet are skipped."""
        at = np.array([_PLACE[c] for c in s if c in _PLACE], np.int64)
        if not len(at):
            return 0.0
        return float((self.first[at[0]] + self.step[at[:-1], at[1:]].sum()) / len(at))


_PLACE = {c: i for i, c in enumerate(ALPHABET)}
#: Where the alphabet's separators begin: letters and digits stand before them.
_SEPARATORS = 62


def train(samples: list[tuple[str, int]], smoothing: float = 0.5) -> MarkovPair:
    """The two models from labelled strings (1 random, 0 ordinary); no samples give a ratio of 0 throughout."""
    n = len(ALPHABET)
    first, step = np.full((2, n), smoothing), np.full((2, n, n), smoothing)
    for s, label in samples:
        at = [_PLACE[c] for c in s if c in _PLACE]
        if at:
            first[label, at[0]] += 1
            np.add.at(step[label], (at[:-1], at[1:]), 1)
    first = np.log(first / first.sum(1, keepdims=True))
    step = np.log(step / step.sum(2, keepdims=True))
    return MarkovPair(first[1] - first[0], step[1] - step[0])


def scan(text: str, model: MarkovPair, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of a text's secrets, by start, then kind; ends are exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    patterns = sorted(found)
    at = 0
    for m in _RUN.finditer(text):
        while at < len(patterns) and patterns[at][1] <= m.start():
            at += 1
        begin = m.start()
        for p in range(at, len(patterns)):  # what the patterns' spans leave of the run
            if patterns[p][0] >= m.end():
                break
            found += [(s, e, 3) for s, e in _random_parts(text, begin, patterns[p][0], model, threshold)]
            begin = max(begin, patterns[p][1])
        found += [(s, e, 3) for s, e in _random_parts(text, begin, m.end(), model, threshold)]
    return sorted(found)


def _repeats(s: str) -> bool:
    """Whether a string is a unit said three times or more (its last time may be cut short)."""
    unit = (s + s).find(s[: len(s) - len(s) // 3], 1)
    return 0 < unit <= len(s) // 3 and all(s[i] == s[i - unit] for i in range(unit, len(s)))


def _segments(at: np.ndarray, model: MarkovPair) -> list[tuple[int, int]]:
    """(start, end) of what is left of a run without its ordinary parts.

    Parts are what stands between separators. Neighbouring parts of a negative ratio that come to
    ``ORDINARY`` or less together are ordinary; the separators next to them go with them.
    """
    inner = at < _SEPARATORS
    edge = np.diff(inner.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return [(0, len(at))]
    steps = np.concatenate([[0.0], np.cumsum(model.step[at[:-1], at[1:]])])
    mass = model.first[at[begin]] + steps[end - 1] - steps[begin]
    out, start, i = [], 0, 0
    while i < len(begin):
        j = i
        while j < len(begin) and mass[j] < 0:
            j += 1
        if j > i and mass[i:j].sum() <= ORDINARY:
            if i:
                out.append((start, int(end[i - 1])))
            start = int(begin[j]) if j < len(begin) else len(at)
        i = max(j, i + 1)
    return [*out, (start, len(at))] if start < len(at) else out


def _random_parts(text: str, begin: int, end: int, model: MarkovPair, threshold: float) -> list[tuple[int, int]]:
    """(start, end) of the stretches of a run that look generated.

    Ordinary parts of the run are in none (``_segments``). A stretch starts and ends at the ends of what is
    left or at separators and has ``CANDIDATE`` characters or more; of those whose ratio per character
    exceeds the threshold the one that exceeds it by most in sum is found. It grows over parts next to it
    that are likelier random, and what is left on either side is searched in the same way. A stretch that
    repeats one unit is no secret.
    """
    if end - begin < CANDIDATE:
        return []
    whole = np.array([_PLACE[c] for c in text[begin:end]], np.int64)
    out, todo = [], [(begin + s, begin + e) for s, e in _segments(whole, model)]
    while todo:
        s, e = todo.pop()
        if e - s < CANDIDATE:
            continue
        at = whole[s - begin : e - begin]
        first, steps = model.first[at], np.concatenate([[0.0], np.cumsum(model.step[at[:-1], at[1:]])])
        inner = at < _SEPARATORS
        starts = np.concatenate([[True], inner[1:] & ~inner[:-1]])
        ends = np.concatenate([inner[:-1] & ~inner[1:], [True]])
        over = threshold * np.arange(len(at))
        low = np.where(starts, first - threshold - steps + over, -np.inf)
        best = np.maximum.accumulate(low)[: len(at) - CANDIDATE + 1] + np.where(ends, steps - over, -np.inf)[CANDIDATE - 1 :]
        if best.max() <= 0:
            continue
        right = int(best.argmax()) + CANDIDATE - 1
        left = int(low[: right - CANDIDATE + 2].argmax())
        gain = np.where(starts, first - steps, -np.inf)[: left + 1]
        left = int(gain.argmax()) if gain.max() > gain[left] else left
        right += int(np.where(ends, steps, -np.inf)[right:].argmax())
        if not _repeats(text[s + left : s + right + 1]):
            out.append((s + left, s + right + 1))
        todo += [(s, s + left), (s + right + 1, e)]
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: MarkovPair | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): one row for each row of ``docs``; spans is an array of (kind, start, end).

    Positions are code points, ends exclusive; spans stand by start, then in the order of ``KINDS``.
    Null and empty texts have none; repeated rows and null doc_ids keep their rows; an empty table gives
    an empty one. ``model`` is trained on ``labelled_samples()`` unless given.
    """
    pair = model or train(labelled_samples())
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(ids: list, texts: list) -> dict:
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in scan(t, pair, threshold)] for t in texts]
        return {"doc_id": ids, "spans": spans}

    return per_batch(id_and_text(docs, id_col, text_col), run, schema, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, text_col: str = "text", model: MarkovPair | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret's span in ``text_col`` replaced by ``[kind]``; all other columns as they were.

    Spans that overlap are replaced together, under the kind of the first. A null text stays null.
    """
    pair = model or train(labelled_samples())

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: t if t is None else _replace(t, scan(t, pair, threshold)))

    return small_batches(docs).withColumn(text_col, clean(F.col(text_col)))


def _replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
