"""Windows in order: documents to events, events to narratives, narratives to attention (E2A-14, E2B-01, STR-02, STR-04, STR-07)."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from tidemark.functions.clock import PER_DAY
from tidemark.functions.stats import pit
from tidemark.operators.attention import HOURS, ChangePoints, decayed, lineage_moves
from tidemark.operators.coupling import Supply, competition, fit_coupled
from tidemark.operators.narratives import EventClusters
from tidemark.operators.stories import NONE, Settings, Stories

HARMONICS, NEIGHBOURS, LEAST_WINDOWS, LEAST_MASS, KEPT_DAYS = (1, 2, 7, 14, 21), 20, 192, 20.0, 28
DECAY = np.exp(-0.25 / np.array(list(HOURS.values())))


def shares_of(y: float, lam: float, base: float, parts: dict[str, float]) -> dict[str, float]:
    """What of y each source accounts for: up to lam in proportion to the base and to positive parts, all beyond to BOT."""
    own = {"BOT": max(base, 0.0), **{j: p for j, p in parts.items() if p > 0}}
    total = sum(own.values())
    explained = min(y, lam)
    out = {j: explained * p / total for j, p in own.items()} if total > 0 else {"BOT": explained}
    out["BOT"] = out.get("BOT", 0.0) + max(y - lam, 0.0)
    return {j: m / y for j, m in sorted(out.items()) if m > 0}


@dataclass
class Replay:
    """The state between two windows. It pickles whole, and a resumed run goes on as if it had not stopped."""

    dims: int
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self) -> None:
        self.events, self.stories = EventClusters(self.dims), Stories(self.dims, self.settings)
        self.roots: dict[str, tuple[float, int]] = {}
        self.traces: dict[str, np.ndarray] = {}
        self.points: dict[str, ChangePoints] = {}
        self.level: dict[str, float] = {}
        self.supply, self.past, self.near, self.theta = Supply(), [], {}, {}
        self.omega, self.beta, self.size, self.refits = 0.0, 0.0, 5.0, 0

    def step(self, t: int, docs: Iterable[dict] | None) -> dict[str, list[dict]]:
        """One window's rows of every table. docs: observation_id, copy_group, vec, entities; None for a missing batch."""
        hours, missing = t * 0.25, docs is None
        out: dict[str, list[dict]] = {k: [] for k in ("memberships", "series", "ledger", "lineage", "attention", "alpha")}
        y, m, held = defaultdict(int), defaultdict(int), []
        lineage: list[dict] = []
        for d in sorted(docs or (), key=lambda d: (d["copy_group"] != d["observation_id"], d["observation_id"])):
            root = d["copy_group"] == d["observation_id"]
            shares, rest = [], 255
            if root and d.get("vec") is not None:
                event, _ = self.events.push(np.asarray(d["vec"], float), d["entities"], hours)
                shares, rest, new = self.stories.push(event, np.asarray(d["vec"], float), d["entities"], hours)
                lineage += new
                self.roots[d["observation_id"]] = (hours, event)
                held.append(d["entities"])
            elif not root and d["copy_group"] in self.roots and hours - self.roots[d["copy_group"]][0] <= 72:
                event = self.roots[d["copy_group"]][1]
                shares, rest = ([(self.stories.home[event], 255)], 0) if event in self.stories.home else ([], 255)
            else:
                event = -1
            for n, p in [*shares, (NONE, rest)]:
                m[n] += p
                y[n] += p if root else 0
            named = [*shares, *[("", 0)] * (3 - len(shares))]
            out["memberships"].append({"observation_id": d["observation_id"], "win": t, "is_root": root, "event_cluster": event, **{f"n{i + 1}": n for i, (n, _) in enumerate(named)}, **{f"p{i + 1}": p for i, (_, p) in enumerate(named)}, "p0": rest})
        self.events.close(held)
        lineage += self.stories.tick(t, hours)
        self.roots = {k: v for k, v in self.roots.items() if hours - v[0] <= 72}
        out["lineage"] = [{"win": t, **e} for e in lineage]
        out["series"] = [{"narrative_id": n, "win": t, "y255": y[n], "m255": m[n]} for n in sorted(m) if n != NONE]
        alive = [s.id for s in self.stories.stories.values() if s.alive]
        out["ledger"] = [{"win": t, "roots": sum(r["is_root"] for r in out["memberships"]), "copies": sum(not r["is_root"] for r in out["memberships"]), "y0_255": y[NONE], "m0_255": m[NONE], "alive": len(alive), "dormant": len(self.stories.stories) - len(alive), "missing": missing}]
        self._attend(t, {n: y[n] / 255 for n in alive}, missing, lineage, out)
        return out

    def _features(self, n: str, hour: int, traces: dict[str, np.ndarray]) -> np.ndarray:
        angle = 2 * np.pi * hour * np.array(HARMONICS) / 168
        return np.concatenate([[1.0], np.cos(angle), np.sin(angle), *(traces.get(j, np.zeros(len(HOURS))) for j in self.near.get(n, [n]))])

    def _refit(self) -> None:
        """At a day's start, from windows before it: neighbours by centroid, then rows of stories with enough history and mass, profiled every seventh time."""
        live = sorted((s for s in self.stories.stories.values() if s.alive), key=lambda s: s.id)
        units = {s.id: s.total / max(float(np.linalg.norm(s.total)), 1e-12) for s in live}
        self.near = {n: [n, *sorted(sorted((o for o in units if o != n), key=lambda o: (-float(units[o] @ v), o))[:NEIGHBOURS])] for n, v in units.items()}
        if len(self.past) < LEAST_WINDOWS:
            return
        counts = {n: np.array([y.get(n, 0.0) for _, y, _, _ in self.past]) for n in units}
        traces = {n: np.stack([decayed(v, h) for h in HOURS.values()], 1) for n, v in counts.items()}
        rows = [n for n in units if counts[n].sum() >= LEAST_MASS]
        if not rows:
            return
        hours = [t // 4 % 168 for t, *_ in self.past]
        designs = {n: np.stack([self._features(n, h, {j: traces[j][i] for j in self.near[n]}) for i, h in enumerate(hours)]) for n in rows}
        f = fit_coupled(designs, {n: counts[n] for n in rows}, np.array([s for *_, s, _ in self.past]), 1 + 2 * len(HARMONICS), np.array([p for *_, p in self.past]), known=None if self.refits % 7 == 0 else (self.omega, self.beta))
        self.theta, self.omega, self.beta, self.size, self.refits = f.theta, f.omega, f.beta, f.size, self.refits + 1

    def _attend(self, t: int, y: dict[str, float], missing: bool, lineage: list[dict], out: dict[str, list[dict]]) -> None:
        self.traces = lineage_moves(self.traces, lineage)
        if t % PER_DAY == 0:
            self._refit()
        hour = t // 4 % 168
        expected = self.supply.forecast(hour)
        raw: dict[str, tuple[float, float, dict[str, float]]] = {}
        for n in sorted(y):
            self.traces.setdefault(n, np.zeros(len(HOURS)))
            x, near, width = self._features(n, hour, self.traces), self.near.get(n, [n]), len(HOURS)
            th = self.theta.get(n)
            if th is None or len(th) != len(x):
                raw[n] = max(self.level.get(n, 0.05), 1e-3), max(self.level.get(n, 0.05), 1e-3), {}
                continue
            free = len(x) - width * len(near)
            parts = {j: float(x[free + width * k : free + width * (k + 1)] @ th[free + width * k : free + width * (k + 1)]) for k, j in enumerate(near)}
            raw[n] = float(np.logaddexp(0, x @ th)), float(x[:free] @ th[:free]), parts
        c = float(competition(expected, sum(v for v, *_ in raw.values()), self.omega, self.beta))
        for n, (v, base, parts) in raw.items():
            lam = max(c * v, 1e-9)
            burst, u = False, None
            if not missing:
                u = pit(round(y[n]), self.size, lam, 0.5)
                short, mean = self.points.setdefault(n, ChangePoints()).push(u)
                burst = short > 0.5 and mean > 0
                if y[n] > 0:
                    out["alpha"] += [{"target": n, "source": s, "win": t, "alpha": a} for s, a in shares_of(y[n], lam, base, parts).items()]
                self.level[n] = self.level.get(n, 0.05) + 0.02 * (y[n] - self.level.get(n, 0.05))
            out["attention"].append({"narrative_id": n, "win": t, "y": y[n], "lam": lam, "pit": u, "burst": burst})
            # a missing window feeds the traces what was expected
            self.traces[n] = DECAY * self.traces[n] + (1 - DECAY) * (lam if missing else y[n])
        self.supply.push(hour, float(out["ledger"][0]["roots"]), missing)
        self.past.append((t, {n: r["lam"] if missing else r["y"] for n, r in ((r["narrative_id"], r) for r in out["attention"])}, expected, not missing))
        del self.past[: max(0, len(self.past) - KEPT_DAYS * PER_DAY)]

    def saved(self) -> bytes:
        return pickle.dumps(self)

    @staticmethod
    def resumed(state: bytes) -> Replay:
        return pickle.loads(state)  # only ever our own checkpoint
