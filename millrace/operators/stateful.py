"""Operators that carry state over an ordered series: the confirm/clear scanner, its streaming form,
and entity linking and chunking of single texts."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "entity string, rule_id string, condition_start long, trigger_at long, last_positive_at long, closed_at long, status string, positive_observations long, qualified_observations long, nonqualifying_observations long, trigger_value double, last_value double"


@dataclass
class Past:
    """What later samples need of earlier ones of their contiguous segment, and the open event."""

    t: int | None = None  # of the newest sample; None before the first and after a break
    v: float | None = None
    same: int = 0  # samples in a row with this value
    begun: int | None = None  # since when the condition holds
    hits: int = 0  # qualifying samples in a row
    quiet: int = 0  # clearing samples since the condition last held
    recent: tuple = ()  # values as far back as the lookback reaches, oldest first
    event: dict | None = None


def _run_start(flag: np.ndarray) -> np.ndarray:
    """For each sample, where the run of equal flags that it stands in begins."""
    at = np.arange(len(flag))
    return np.maximum.accumulate(np.where(np.concatenate(([True], flag[1:] != flag[:-1])), at, 0))


_CONDITIONS = {
    "gt": lambda s, v, same, earlier: v > s.value,
    "lt": lambda s, v, same, earlier: v < s.value,
    "outside": lambda s, v, same, earlier: (v < s.value) | (v > (np.inf if s.second is None else s.second)),
    "stuck_exact": lambda s, v, same, earlier: same >= s.value,
    "delta_gt": lambda s, v, same, earlier: v - earlier > s.value,
}


@dataclass
class Scanner:
    """One rule over one series; finished events collect in `out`.

    An event opens after `confirm` qualifying samples in a row (the condition, having lasted strictly
    longer than `duration`); while open, the condition alone keeps it alive; `clear` samples in a row
    without it close it as recovered. A gap or a missing value closes it as data_gap_unconfirmed.
    For delta_gt a sample without its earlier value neither clears nor keeps alive.

    Everything but opening and closing is a column of the segment: runs, conditions and counts are
    arrays, and events are found by stepping from one opening to the next closing among them."""

    op: str
    value: float
    second: float | None = None
    duration: int = 0
    window: int = 0
    step: int = 3600
    confirm: int = 2
    clear: int = 2
    past: Past = field(default_factory=Past)
    out: list = field(default_factory=list)

    def feed(self, t: int, v: float | None) -> None:
        self.run(np.array([t], np.int64), np.array([np.nan if v is None else v], np.float64))

    def run(self, t: np.ndarray, v: np.ndarray) -> None:
        """Samples by rising time, later than those before."""
        there = np.isfinite(v)
        follows = np.zeros(len(t), bool)
        follows[1:] = there[1:] & there[:-1] & (np.diff(t) == self.step)
        if len(t) and there[0] and self.past.t is not None:
            follows[0] = t[0] - self.past.t == self.step
        edges = np.flatnonzero(~follows).tolist()
        if len(t) and follows[0]:
            edges.insert(0, 0)
        for a, b in zip(edges, [*edges[1:], len(t)], strict=True):
            if not follows[a]:
                self._end("data_gap_unconfirmed", self.past.t)
                self.past = Past()
            if there[a]:
                self._segment(t[a:b], v[a:b])

    def finish(self) -> None:
        self._end("open_at_data_end", None)

    def _end(self, status: str, at: int | None) -> None:
        if (e := self.past.event) is not None:
            self.out.append(e | {"status": status, "closed_at": at})
            self.past.event = None

    def _segment(self, t: np.ndarray, v: np.ndarray) -> None:
        p, at = self.past, np.arange(len(t))
        level = _run_start(np.concatenate(([0], np.cumsum(v[1:] != v[:-1]))))
        same = at - level + 1 + np.where((level == 0) & (v[0] == p.v), p.same, 0)
        earlier, back = np.full(len(t), np.nan), self.window // self.step if self.window % self.step == 0 else 0
        known = np.concatenate((np.array(p.recent, np.float64), v))
        if back:
            place = at + len(p.recent) - back
            earlier[place >= 0] = known[place[place >= 0]]
        ready = np.isfinite(earlier) if self.op == "delta_gt" else np.ones(len(t), bool)
        holds = ready & _CONDITIONS[self.op](self, v, same, earlier)
        since = _run_start(holds)
        begun = np.where((since == 0) & holds & (p.begun is not None), p.begun if p.begun is not None else 0, t[since])
        good = holds & ((t - begun > self.duration) if self.duration else True)
        run = _run_start(good)
        hits = np.where(good, at - run + 1 + np.where(run == 0, p.hits, 0), 0)
        idle = np.cumsum(ready & ~holds)
        last = np.maximum.accumulate(np.where(holds, at, -1))
        quiet = idle - np.where(last >= 0, idle[last], -p.quiet)
        sums = {"positive_observations": np.cumsum(holds), "qualified_observations": np.cumsum(good), "nonqualifying_observations": idle}
        opens, closes = np.flatnonzero(hits >= self.confirm), np.flatnonzero((quiet >= self.clear) & ~holds)
        done = 0
        while True:
            if p.event is None:
                if (k := np.searchsorted(opens, done)) == len(opens):
                    break
                i = int(opens[k])
                start = t[i] - (same[i] - 1) * self.step if self.op == "stuck_exact" else begun[i]
                p.event = {"condition_start": int(start), "trigger_at": int(t[i]), "last_positive_at": int(t[i]), "positive_observations": self.confirm, "qualified_observations": self.confirm, "nonqualifying_observations": 0, "trigger_value": float(v[i]), "last_value": float(v[i])}
                done = i + 1
            k = np.searchsorted(closes, done)
            end = int(closes[k]) + 1 if k < len(closes) else len(t)
            if end > done:
                for name, total in sums.items():
                    p.event[name] += int(total[end - 1] - (total[done - 1] if done else 0))
                if (j := int(last[end - 1])) >= done:
                    p.event["last_positive_at"], p.event["last_value"] = int(t[j]), float(v[j])
            if k == len(closes):
                break
            self._end("recovered", int(t[end - 1]))
            done = end
        self.past = Past(int(t[-1]), float(v[-1]), int(same[-1]), int(begun[-1]) if holds[-1] else None, int(hits[-1]), int(quiet[-1]), tuple(known[-back:].tolist()) if back else (), p.event)


def _frame(entity: str, rule: str, events: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in EVENT.split(", ")]
    rows = pd.DataFrame([{"entity": entity, "rule_id": rule} | e for e in events], columns=names)
    rows["closed_at"] = rows["closed_at"].astype("Int64")
    return rows


RULE = ("rule_id", "op", "value", "second", "duration", "window")


def _scanner(row, step: int, confirm: int, clear: int) -> Scanner:
    opt = lambda x: None if x is None or pd.isna(x) else float(x)
    return Scanner(row["op"], float(row["value"]), opt(row["second"]), int(opt(row["duration"]) or 0), int(opt(row["window"]) or 0), step, confirm, clear)


def scan(series: DataFrame, rules: DataFrame, step: int, confirm: int = 2, clear: int = 2) -> DataFrame:
    """Events of series(entity, t, v) under rules(entity, rule_id, op, value, second, duration,
    window): one group a series and rule, in order of time."""
    joined = series.select("entity", "t", "v").join(rules.select("entity", *RULE), "entity")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        s = _scanner(pdf.iloc[0], step, confirm, clear)
        s.run(pdf["t"].to_numpy(np.int64), pdf["v"].to_numpy(np.float64))
        s.finish()
        return _frame(key[0], key[1], s.out)

    return joined.groupBy("entity", "rule_id").applyInPandas(run, EVENT)


def nearest_compose(question_spans: DataFrame) -> DataFrame:
    """Entity links by text of spans(text_id, kind, node, alias, start, end): overlapping spans of a
    kind lose to longer ones, then each type span takes the nearest station span."""
    schema = "text_id long, node string, alias string, start int, end int, kind string"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = []
        for kind, group in pdf.groupby("kind"):
            taken: list = []
            for r in sorted(group.itertuples(), key=lambda r: (r.start - r.end, r.start, r.node)):
                if all(r.end <= o.start or r.start >= o.end for o in taken):
                    taken.append(r)
            chosen += [(kind, r) for r in taken]
        stations = [r for k, r in chosen if k == "station"]
        out = [(key[0], r.node, r.alias, r.start, r.end, k) for k, r in chosen]
        for k, r in chosen:
            if k == "type":
                far = sorted((max(r.start - s.end, s.start - r.end, 0), s.start, s) for s in stations)
                if far and far[0][0] <= 14:
                    s = far[0][2]
                    out.append((key[0], f"{s.node}_{r.node}", f"{s.alias}+{r.alias}", min(r.start, s.start), max(r.end, s.end), "sensor"))
        return pd.DataFrame(sorted(out, key=lambda x: (x[3], x[1])), columns=[c.split()[0] for c in schema.split(", ")])

    return question_spans.groupBy("text_id").applyInPandas(run, schema)


def alias_spans(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(text_id, kind, node, alias, start, end) of every place where an alias stands as an entity. aliases
    is a lexicon (hundreds of rows) and goes to every task as one pattern by kind."""
    rows = [(r.kind, r.node, r.alias) for r in aliases.select("kind", "node", "alias").collect()]

    def run(batches):
        # by kind, aliases that an ASCII word boundary or none at all must surround
        kinds: dict[tuple[str, bool], dict[str, list[tuple[str, str]]]] = {}
        for kind, node, alias in rows:
            kinds.setdefault((kind, alias.isascii()), {}).setdefault(alias.lower(), []).append((node, alias))
        found = []
        for (kind, plain), names in kinds.items():
            words = "|".join(re.escape(a) for a in sorted(names, key=lambda a: (-len(a), a)))
            # a lookahead, so that aliases inside or across one another are all seen
            pattern = rf"(?<![A-Za-z0-9_-])(?=({words})(?![A-Za-z0-9_]))" if plain else f"(?=({words}))"
            found.append((kind, plain, names, re.compile(pattern, re.I)))
        for pdf in batches:
            out = []
            for i, t in zip(pdf["text_id"], pdf["text"], strict=True):
                for kind, plain, names, pattern in found if t else ():
                    ends: dict[str, int] = {}
                    for m in pattern.finditer(t):
                        # the longest alias here, and shorter ones that it begins with
                        for size in range(len(m[1]), 0, -1):
                            alias, end = m[1][:size].lower(), m.start() + size
                            if alias in names and ends.get(alias, 0) <= m.start() and not (plain and re.match("[A-Za-z0-9_]", t[end : end + 1])):
                                ends[alias] = end
                                out += [(i, kind, node, a, m.start(), end) for node, a in names[alias]]
            yield pd.DataFrame(out, columns=["text_id", "kind", "node", "alias", "start", "end"])

    return texts.select("text_id", "text").mapInPandas(run, "text_id long, kind string, node string, alias string, start int, end int")


def chunk_text(text: str, most: int = 1000, overlap: int = 200) -> list[tuple[int, int]]:
    """Spans of at most `most` characters that end at the last space of their second half, where
    there is one, and share up to `overlap` with the next. Blank ones are left out. The places of
    spaces are listed once and searched by bisection, so long texts take time in proportion."""
    spaces = [m.start() for m in re.finditer(" ", text)]

    def end_of(begin: int) -> int:
        if (limit := begin + most) >= len(text):
            return len(text)
        k = bisect.bisect_left(spaces, limit)
        return spaces[k - 1] if k and spaces[k - 1] >= max(1, begin + most // 2) else limit

    ends = [(0, end_of(0))] if text else []
    while ends and ends[-1][1] < len(text):
        begin = max(ends[-1][0] + 1, ends[-1][1] - overlap)
        ends.append((begin, end_of(begin)))
    return [(a, b) for a, b in ends if not text[a:b].isspace()]


def chunks(texts: DataFrame, id_col: str, text: str, most: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, chunk, start, end, text) by chunk_text()."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = [(i, k, a, b, t[a:b]) for i, t in zip(pdf["id"], pdf["text"], strict=True) if t for k, (a, b) in enumerate(chunk_text(t, most, overlap), 1)]
            yield pd.DataFrame(out, columns=["id", "chunk", "start", "end", "text"])

    return texts.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, chunk int, start int, end int, text string")
