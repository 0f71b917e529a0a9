"""Claims, conflicts and verdicts (E3B-02..11)."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.groups import by_group

# Wordings that make a claim, by predicate.
WORDING = {
    "released": r"\b(releases?|released|launch(es|ed)?|unveil(s|ed)?|rolls? out|debuts?|introduc(es|ed))\b",
    "ranks_top": r"\b(tops|topped|hits? (no\.?|number) ?1|no\.? ?1|surpass(es|ed)|overtak(es|en)|dethron\w*)\b",
    "restricts_exports": r"\b(export (controls?|curbs?|restrictions?|ban)|chip (ban|curbs?|restrictions?))\b",
    "capability_parity": r"\b(rivals?|on par|matches|as good as|outperforms?|beats?|comparable to)\b",
    "denies": r"\b(denied|denies|deny|refuted|rejects?|dismiss\w*|disput\w*)\b",
    "alleges": r"\b(alleg\w*|accus\w*|claims?|suspect\w*|reportedly)\b",
}
# Wording of negations, of costs and spending, and of what a figure covers.
NEGATION = r"\b(no|not|never|denied|denies|deny|false|untrue|refuted|rejects?)\b"
COST = r"\b(dollar|usd|cost|train|spent|spend|budget)\w*"
SPENDING = r"\b(capex|capital expenditure|invest\w*|data cent\w*|infrastructure)\b"
SCOPES = {
    "final_run_only": r"\b(excluding|excludes|exclude|not includ\w*|only the final|final (training )?run|official training|does not include|doesn'?t include)\b",
    "all_in": r"\b(total cost|all[- ]in|entire|in total|everything|from scratch)\b",
}
# The object of a claim where its wording names none.
VALUES = {"released": "model", "ranks_top": "chart", "restricts_exports": "chips", "capability_parity": "frontier"}
# What a denial or an allegation is about, the first that occurs.
OBJECTS = ("smuggl", "export", "distill", "copied", "stole", "chips", "cost", "training")
# First-hand domains, wires and national outlets, and outlets under one owner.
PRIMARY = (
    "arxiv.org", "github.com", "sec.gov", "huggingface.co", "deepseek.com", "nvidia.com", "microsoft.com",
    "openai.com", "meta.com", "google.com", "blog.google", "apple.com", "amazon.com", "tsmc.com", "broadcom.com",
    "vistracorp.com", "constellationenergy.com", "nrg.com", "federalreserve.gov", "bls.gov", "whitehouse.gov",
    "commerce.gov", "bis.doc.gov", "ec.europa.eu", "gov.cn",
)
NATIONAL = (
    "reuters.com", "apnews.com", "bloomberg.com", "afp.com", "wsj.com", "ft.com", "nytimes.com",
    "washingtonpost.com", "cnbc.com", "bbc.co.uk", "bbc.com", "theguardian.com", "economist.com", "cnn.com",
    "nbcnews.com", "abcnews.go.com", "cbsnews.com", "npr.org", "marketwatch.com", "barrons.com", "forbes.com",
    "fortune.com", "businessinsider.com", "axios.com", "politico.com", "scmp.com", "nikkei.com",
    "theverge.com", "techcrunch.com", "wired.com", "arstechnica.com", "latimes.com", "usatoday.com",
    "foxbusiness.com", "foxnews.com", "aljazeera.com", "dw.com", "france24.com", "japantimes.co.jp",
    "straitstimes.com", "theaustralian.com.au", "abc.net.au", "cbc.ca", "globeandmail.com", "independent.co.uk",
    "telegraph.co.uk", "thetimes.co.uk", "time.com", "newsweek.com", "yahoo.com", "investing.com",
)
OWNERS = {"iheart.com": "iheartmedia", "patch.com": "patch", "newsquest.co.uk": "newsquest", "gannett.com": "gannett", "msn.com": "microsoft-msn", "yahoo.com": "yahoo"}
LABELS = ("SUPPORTED", "CONTRADICTED", "UNRESOLVED", "CONSISTENT-BUT-UNPROVEN")


def tier(domain: Column) -> Column:
    return F.when(domain.endswith(".gov") | domain.contains(".gov.") | domain.isin(*PRIMARY), 1).when(domain.isin(*NATIONAL), 2).otherwise(3)


def owner(domain: Column) -> Column:
    out = domain
    for d, o in OWNERS.items():
        out = F.when(domain == d, o).otherwise(out)
    return out


def _says(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def about(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(k), k) for k in OBJECTS], F.lit("claim"))


def _claim(predicate: str, value: Column, polarity: Column | None = None) -> Column:
    return F.struct(F.lit(predicate).alias("predicate"), value.alias("value"), F.lit("unspecified").alias("scope"), (F.lit(1) if polarity is None else polarity).alias("polarity"))


def title_claims(title: Column) -> Column:
    """An array of (predicate, value, scope, polarity); a denial outweighs an allegation."""
    sign = F.when(_says(title, NEGATION), -1).otherwise(1)
    made = [F.when(_says(title, WORDING[p]), _claim(p, F.lit(v), sign if p == "restricts_exports" else F.lit(1))) for p, v in VALUES.items()]
    made.append(F.when(_says(title, WORDING["denies"]), _claim("denies", about(title))).when(_says(title, WORDING["alleges"]), _claim("alleges", about(title))))
    return F.filter(F.array(*made), lambda c: c.isNotNull())


def quote_claims(quotes: Column) -> Column:
    """From an array of (verb, quote)."""
    denies = lambda q: _says(q["verb"], WORDING["denies"]) | (_says(q["quote"], NEGATION) & _says(q["quote"], WORDING["denies"]))
    made = F.transform(quotes, lambda q: F.when(denies(q), _claim("denies", about(q["quote"]))).when(_says(q["verb"], WORDING["alleges"]), _claim("alleges", about(q["quote"]))))
    return F.filter(made, lambda c: c.isNotNull())


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+|\\n+"), lambda x: F.trim(x)), lambda s: s != "")


def scope_of(sentence: Column) -> Column:
    return F.coalesce(*[F.when(_says(sentence, p), s) for s, p in SCOPES.items()], F.lit("unspecified"))


def amount_claims(amounts: Column, text: Column) -> Column:
    """From an array of (amount, object): costs and spending, with the scope of the first sentence that holds the object."""

    def one(a: Column) -> Column:
        low = F.lower(F.trim(a["object"]))
        kind = F.when(_says(a["object"], COST), "cost_of").when(_says(a["object"], SPENDING), F.when(low.contains("capex") | low.contains("capital"), "guides_capex").otherwise("invests"))
        held = F.get(F.filter(sentences(text), lambda s: (low != "") & F.lower(s).contains(low)), F.lit(0))
        return F.when(kind.isNotNull(), F.struct(kind.alias("predicate"), F.format_string("%.6g", a["amount"]).alias("value"), F.when(held.isNotNull(), scope_of(held)).otherwise("unspecified").alias("scope"), F.lit(1).alias("polarity")))

    return F.filter(F.transform(amounts, one), lambda c: c.isNotNull())


def grounded(span: Column, page: Column) -> Column:
    """A claim's words stand in the page as they are, but for case and white space."""
    even = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    return (even(span) != "") & even(page).contains(even(span))


@dataclass(frozen=True)
class Literal:
    subject: str
    predicate: str
    value: str
    scope: str
    polarity: int


def contrary(a: Literal, b: Literal) -> bool:
    """One subject, and opposite polarity, whole against partial cost, or allegation against denial of one thing."""
    if a.subject != b.subject:
        return False
    same = a.predicate == b.predicate
    costs = a.predicate == "cost_of" and {a.scope, b.scope} == {"all_in", "final_run_only"}
    return same and (a.polarity != b.polarity or costs) or {a.predicate, b.predicate} == {"alleges", "denies"} and a.value == b.value


@dataclass
class Report:
    """A source's report of an event (literal None), or of a claim."""

    id: str
    owner: str
    group: str
    tier: int
    literal: Literal | None = None
    copy: bool = False


@dataclass
class Hypothesis:
    reports: list[Report] = field(default_factory=list)
    before: bool = True
    signature: bool = True


def independent(a: Report, b: Report) -> bool:
    return a.owner != b.owner and a.group != b.group


def _stable(nodes: list[int], attacks: dict[int, set[int]]) -> list[frozenset[int]]:
    """Sets without inner attacks that attack all others. attacks[x] is who attacks x.

    Undecided nodes go one at a time, after those whose fate is forced.
    """
    victims: dict[int, set[int]] = defaultdict(set)
    for x in nodes:
        for y in attacks[x]:
            victims[y].add(x)
    found = []

    def go(ins: set[int], outs: set[int]) -> None:
        while True:
            more_in = {x for x in nodes if x not in ins and x not in outs and attacks[x] <= outs}
            more_out = {x for x in nodes if x not in outs and attacks[x] & (ins | more_in)}
            if more_out & (ins | more_in):
                return
            if not more_in and not more_out - outs:
                break
            ins, outs = ins | more_in, outs | more_out
        left = [x for x in nodes if x not in ins and x not in outs]
        if not left:
            if all(attacks[y] & ins for y in outs):
                found.append(frozenset(ins))
            return
        x = left[0]
        if not victims[x] & ins:
            go(ins | {x}, outs | victims[x] | attacks[x])
        # x out: one of its attackers has to be in
        for y in sorted(attacks[x] - outs - {x}):
            if y not in ins and not victims[y] & ins and not attacks[y] & ins:
                go(ins | {y}, outs | victims[y] | attacks[y])

    go(set(), {x for x in nodes if x in attacks[x]})
    return sorted(set(found), key=sorted)


def decide(hypotheses: dict[str, Hypothesis], cap: int = 1000) -> dict[str, tuple[tuple[int, int, int, int], str, int]]:
    """Per hypothesis (bIN, cIN, bOUT, cOUT), its label, and the number of readings, up to cap.

    A report of a claim falls to an independent one of a contrary claim whose tier isn't lower;
    a reading is a stable set of reports. A hypothesis is refuted in a reading that holds a claim
    contrary to one of its own.
    """
    reports = [(h, r) for h, x in sorted(hypotheses.items()) for r in x.reports if r.literal is not None]
    against: dict[Literal, set[Literal]] = defaultdict(set)
    refuters: dict[str, set[Literal]] = defaultdict(set)
    literals = {r.literal for _, r in reports}
    for a, b in product(literals, literals):
        if contrary(a, b):
            against[a].add(b)
    for h, r in reports:
        refuters[h] |= against[r.literal]
    live = [i for i, (_, r) in enumerate(reports) if not r.copy]
    attacks = {i: {j for j in live if j != i and reports[j][1].literal in against[reports[i][1].literal] and independent(reports[i][1], reports[j][1]) and reports[j][1].tier <= reports[i][1].tier} for i in live}
    # readings of parts without attacks between them combine freely
    part: dict[int, int] = {i: i for i in live}

    def top(i: int) -> int:
        while part[i] != i:
            i = part[i]
        return i

    for i, js in attacks.items():
        for j in js:
            part[max(top(i), top(j))] = min(top(i), top(j))
    groups: dict[int, list[int]] = defaultdict(list)
    for i in live:
        groups[top(i)].append(i)
    readings = [_stable(g, attacks) for g in groups.values()]
    n = 1
    for r in readings:
        n = min(cap, n * len(r))
    out = {}
    for h, x in hypotheses.items():
        witnesses = [r for r in x.reports if r.literal is None and not r.copy]
        corroborated = any(r.tier <= 2 for r in witnesses) or any(independent(a, b) for k, a in enumerate(witnesses) for b in witnesses[k + 1 :])
        det = bool(witnesses) and corroborated and x.before and x.signature
        holds = [[any(reports[i][1].literal in refuters[h] for i in s) for s in r] for r in readings]
        some, all_ = any(any(r) for r in holds), any(r and all(r) for r in holds)
        bits = (int(det and not all_), int(det and not some), int(some), int(all_))
        label = LABELS[0] if bits[1] else LABELS[1] if bits[3] else LABELS[2] if bits[2] else LABELS[3]
        out[h] = bits, label, n
    return out


def diagnostic(hypotheses: dict[str, Hypothesis], h: str) -> list[str]:
    """Reports without which the label of h would be another."""
    label, out = decide(hypotheses)[h][1], []
    for g, x in hypotheses.items():
        for r in x.reports:
            less = {**hypotheses, g: Hypothesis([y for y in x.reports if y is not r], x.before, x.signature)}
            if decide(less)[h][1] != label:
                out.append(r.id)
    return sorted(out)


FACTS = "hypothesis string, id string, owner string, grp string, tier int, subject string, predicate string, value string, scope string, polarity int, copy boolean, before boolean, signature boolean"


def event_facts(events: DataFrame) -> DataFrame:
    """Facts out of an event stream: users as hypotheses, purchases as witnesses, errors and logins as claims for and against."""
    e = events.where(F.col("event_type").isNotNull() & F.col("user_id").isNotNull())
    k = F.col("event_id") % 7
    claim = F.col("event_type").isin("error", "login")
    null = F.lit(None).cast("string")
    return e.select(
        F.col("user_id").cast("string").alias("hypothesis"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("o"), k).alias("owner"), F.concat(F.lit("g"), F.col("event_id") % 11).alias("grp"),
        (1 + F.col("event_id") % 3).cast("int").alias("tier"), F.when(claim, F.concat(F.lit("u"), F.col("user_id"))).otherwise(null).alias("subject"), F.when(claim, "cost_of").otherwise(null).alias("predicate"),
        F.when(claim, F.lit("1")).otherwise(null).alias("value"), F.when(claim, "unspecified").otherwise(null).alias("scope"), F.when(F.col("event_type") == "error", -1).when(claim, 1).cast("int").alias("polarity"),
        (F.col("event_id") % 13 == 0).alias("copy"), F.lit(True).alias("before"), (F.col("user_id") % 5 != 0).alias("signature"),
    )


def decide_facts(facts: DataFrame, case: str = "hypothesis") -> DataFrame:
    """(hypothesis, b_in, c_in, b_out, c_out, label, readings); facts of one case are judged together.

    Reports alike in owner, group, tier, literal and copy stand and fall together, so one of each
    is judged; the number of cases' facts is then bounded by their kinds, whatever the rows.
    """
    alike = facts.groupBy(case, *[c for c in dict.fromkeys(["hypothesis", "owner", "grp", "tier", "subject", "predicate", "value", "scope", "polarity", "copy"]) if c != case]).agg(F.min("id").alias("id"), F.bool_or("before").alias("before"), F.bool_and("signature").alias("signature"))

    def run(own: pd.DataFrame) -> list[tuple]:
        hs: dict[str, Hypothesis] = {}
        for r in own.sort_values("id").itertuples():
            lit = Literal(r.subject, r.predicate, r.value, r.scope, int(r.polarity)) if isinstance(r.predicate, str) else None
            h = hs.setdefault(r.hypothesis, Hypothesis(before=False))
            h.before, h.signature = h.before or bool(r.before), h.signature and bool(r.signature)
            h.reports.append(Report(r.id, r.owner, r.grp, int(r.tier), lit, bool(r.copy)))
        return [(h, *bits, label, n) for h, (bits, label, n) in sorted(decide(hs).items())]

    return by_group(alike, case, run, "hypothesis string, b_in int, c_in int, b_out int, c_out int, label string, readings int")


def certificate(label: str, consequences: dict[str, list[str]]) -> str:
    """CERT- and 16 hex digits over sorted lists of consequences."""
    parts = [label, *(f"{k}={sorted(v)}" for k, v in sorted(consequences.items()))]
    return "CERT-" + hashlib.sha256("::".join(parts).encode()).hexdigest()[:16]


def redacted(value, drop: tuple[str, ...] = ("api_key", "serpapi_key", "token")):
    """PF-11: a JSON value without sensitive fields, at any depth."""
    if isinstance(value, dict):
        return {k: redacted(v, drop) for k, v in value.items() if k.lower() not in drop}
    if isinstance(value, list):
        return [redacted(v, drop) for v in value]
    return re.sub(r"(?i)(api_key=)[^&\s]+", r"\1REDACTED", value) if isinstance(value, str) else value
