"""Personal data: high-recall generators propose spans, gradient-boosted trees and calibrated thresholds choose.

Everything that touches texts is a column expression. Four kinds have a fixed definition (email, ip, card, phone);
their spans always stay. Further generators propose spans that may overlap: phone numbers without a country code,
national numbers, bank account numbers, IPv6 addresses and secrets. Each proposal gets features of its form and of its
context; boosted regression trees, trained here on invented lines whose writer knows what they hold, are compiled to
CASE expressions that score it, and its kind's threshold, calibrated on other lines, decides.

Defined cases: a null text counts as empty and has no spans; texts of any length are read whole; repeated rows are
each reported; other columns are kept by redact() and ignored by report(); an empty table gives an empty result.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds with a fixed definition, in the order in which spans with one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("local_phone", "national_id", "iban", "ipv6", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

# The definitions of the base kinds, written so that no start is tried twice within a run of characters.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_ADDED = {
    "local_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[ -]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])",
    "secret": r"(?<![0-9A-Za-z_+/-])[0-9A-Za-z_+/-]{20,}+(?:\.[0-9A-Za-z_+/-]{20,}+)*+={0,2}+",
}
#: Words before a span that speak for its kind, and such as speak against it.
_CUE = {
    "local_phone": r"(?i)(?:tel|phone|call|mobile|cell|fax|dial|whatsapp|telefon|móvil|reach|ring)[^0-9\n]{0,14}$",
    "national_id": r"(?i)(?:ssn|social|security|insurance|national|tax)[^0-9\n]{0,16}$",
    "iban": r"(?i)(?:iban|account|konto|cuenta|compte|bank)[^0-9\n]{0,12}$",
    "ipv6": r"(?i)(?:ip|host|server|address|addr|from|inet6?)[^0-9\n]{0,12}$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|client[ _-]?key|bearer|auth|authorization|credentials?|cookie|session|jwt|signature)(?:[ _-]?(?:id|key|token))?[\"' ]{0,2}(?:[=:]|is| )[\"' ]{0,3}(?:bearer |basic )?$",
}
_AGAINST = {
    "local_phone": r"(?i)(?:count|total|page|pages|row|rows|range|version|part|no|item|score|coordinates|between)[^0-9\n]{0,8}$",
    "national_id": r"(?i)(?:part|serial|model|order|ticket|case|range|room|item|sku)[^0-9\n]{0,10}$",
    "iban": r"(?i)(?:part|serial|model|order|sku|tracking|code)[^0-9\n]{0,10}$",
    "ipv6": r"(?i)(?:time|at|mac|clock|duration|hash|fingerprint)[^0-9\n]{0,8}$",
    "secret": r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|digest|hash|blob|tree|revision|rev|build|version|uuid|guid|path|file|https?:/|ftp:/|/|class|function|method|import|from|word|gene|sequence|isbn|id)[\"' ]{0,2}[=:#( ]?[\"' ]{0,2}$",
}
#: Bytes before a span that count as its context.
CONTEXT = 48

FEATURES = ("kind", "cue", "against", "length", "digits", "distinct", "letters", "case_mix", "switches", "groups", "checked")


def _null_safe(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f, or a lambda in it, refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Matches whose positions are summed at once.
_STEP = 256


_SPAN = "array<struct<start:bigint,end:bigint,from:bigint,to:bigint,value:string>>"


def _running(items: Column, begin: Column, one: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states (structs, as begin) after each of the items, in steps of _STEP so that the arrays that grow stay short."""
    none = F.array().cast(f"array<{kind}>")

    def add(acc: Column, x: Column) -> Column:
        state = one(acc["now"], x)
        return _bound(state, lambda now: F.struct(now.alias("now"), F.concat(acc["out"], F.array(now)).alias("out")))

    def step(acc: Column, part: Column) -> Column:
        return F.concat(acc, F.array(F.aggregate(part, F.struct(F.element_at(acc, -1)["now"].alias("now"), none.alias("out")), add)))

    def assembled(all_items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / _STEP).cast("int")), lambda i: F.slice(all_items, i * _STEP + 1, _STEP))
        return F.aggregate(parts, F.array(F.struct(begin.cast(kind).alias("now"), none.alias("out"))), step, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))

    return F.when(F.size(items) == 0, none).otherwise(_bound(items, assembled))


def _found(text: Column, pattern: str) -> Column:
    """Matches with their starts and ends, in code points and in bytes: the pieces between matches give the positions."""
    long = lambda c: c.cast("bigint")
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kind = _SPAN.removeprefix("array<").removesuffix(">")

    def one(acc: Column, x: Column) -> Column:
        start = acc["end"] + long(F.length(x["piece"]))
        at = acc["to"] + long(F.octet_length(x["piece"]))
        ends = start + long(F.length(x["match"])), at + long(F.octet_length(x["match"]))
        return F.struct(start.alias("start"), ends[0].alias("end"), at.alias("from"), ends[1].alias("to"), x["match"].alias("value"))

    zero = long(F.lit(0))
    begin = F.struct(zero.alias("start"), zero.alias("end"), zero.alias("from"), zero.alias("to"), F.lit("").alias("value"))
    # One piece more than matches: its match is null, and it ends the text.
    zipped = F.zip_with(matches, pieces, lambda m, p: F.struct(m.alias("match"), p.alias("piece")))
    return F.filter(_running(zipped, begin, one, kind), lambda x: x["value"].isNotNull())


def _none() -> Column:
    return F.array().cast(_SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a base kind's pattern is one."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\.", -1), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    n = F.length(_digits(value))
    return n.between(14, 19) & F.call_function("luhn_check", _digits(value)) if kind == "card" else n.between(10, 15)


def _valid(kind: str):  # noqa: ANN202
    return lambda x: _holds(kind, x["value"])


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind: arrays of (start, end, value)."""
    text = _null_safe(text)
    out = {}
    for kind, pattern in _BASE.items():
        may = F.contains(text, F.lit({"email": "@", "ip": ".", "phone": "+"}[kind])) if kind != "card" else F.lit(True)
        if kind != "email":
            may = may & text.rlike("[0-9]")
        out[kind] = F.when(may, F.filter(_found(text, pattern), _valid(kind))).otherwise(_none())
    return out


# --- the boosted trees -------------------------------------------------------------------------------------------


def _row(kind: str, before: str, value: str) -> list[float]:
    """The features of one example, as the column expressions compute them."""
    context = before.encode()[-CONTEXT:].decode(errors="replace")
    digits = "".join(c for c in value if c in "0123456789")
    letters = sum(c.isascii() and c.isalpha() for c in value)
    upper = sum("A" <= c <= "Z" for c in value)
    groups, switches = len(re.findall("[0-9A-Za-z]+", value)), len(re.findall("[0-9](?=[A-Za-z])", value))
    cues = float(bool(re.search(_CUE[kind], context))), float(bool(re.search(_AGAINST[kind], context)))
    return [KINDS.index(kind), *cues, len(value), len(digits), len(set(digits)), letters, float(0 < upper < letters), switches, groups, float(_checked(kind, value))]


def _checked(kind: str, value: str) -> bool:
    if kind == "national_id":
        return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"
    if kind == "iban":
        plain = value.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return False


# Lines as people write them. What stands in braces is drawn at random; the mark before a line tells whether it is
# personal data or a secret (1), or something of the same form that is not (0).
_LINES = {
    "local_phone": """1 call {phone} 1 phone: {phone} 1 Tel. {phone} 1 my number is {phone} 1 fax ({phone}) 1 reach me at {area} 1 you can ring {area} 1 contact {area} 1 mobile {phone} 1 WhatsApp {phone}
        0 a total of {count} 0 rows {count} 0 from {count} to 0 the years {years} 0 count: {count} 0 version {count} 0 between {years} 0 pages {count} 0 coordinates {count} 0 scores of {count} 0 {count}""",
    "national_id": """1 ssn: {ssn} 1 SSN {ssn} 1 social security number {ssn} 1 national insurance {ssn} 1 tax id {ssn} 1 his social is {ssn} 0 part {serial} 0 order {serial} 0 serial {serial} 0 see item {serial} 0 room {serial} 0 ticket no. {serial} 0 {serial} 0 range {serial}""",
    "iban": """1 iban {iban} 1 IBAN: {iban} 1 account {iban} 1 pay to {iban} 1 {iban} 1 konto {iban} 1 transfer {iban} 0 part {near_iban} 0 tracking {near_iban} 0 code {near_iban} 0 serial {near_iban} 0 {near_iban} 0 order {near_iban}""",
    "ipv6": """1 ip {ipv6} 1 host {ipv6} 1 server at {ipv6} 1 inet6 {ipv6} 1 from {ipv6} 1 {ipv6} 1 connect to {ipv6} 0 at {clock} 0 time {clock} 0 {clock} 0 mac {mac} 0 fingerprint {mac} 0 took {clock} 0 duration {clock}""",
    "secret": """1 token={key} 1 token = "{key}" 1 api_key={key} 1 api_key = {prefixed} 1 API-KEY: {key} 1 secret: '{key}' 1 password={key} 1 Authorization: Bearer {jwt} 1 Authorization: Bearer {key} 1 jwt={jwt} 1 cookie: {jwt} 1 SECRET_ACCESS_KEY={key}
        1 passwd {key} 1 auth_token: "{key}" 1 client_secret={key} 1 session={long_key} 1 private_key={long_key} 1 token {key} 1 access key {prefixed} 1 the token is {key} 1 use {prefixed} 1 {jwt} 1 "{prefixed}" 1 pwd={key} 1 credentials: {key}
        0 commit {hex} 0 sha256:{hex} 0 md5 {hex} 0 checksum: {hex} 0 https://host/{path} 0 see {path} 0 file {path} 0 class {camel} 0 function {snake} 0 {snake} 0 {word} 0 {upper} 0 {digits} 0 {dashes} 0 uuid {uuid} 0 id={uuid} 0 build {hex} 0 {camel}
        0 gene {bases} 0 {bases} 0 sequence {long_word} 0 {long_word} 0 import {snake} 0 {path} 0 the word {word} 0 token {snake} 0 password {word} 0 the run {long_key} 0 blob {long_key} 0 {long_key} 0 some data {long_key} 0 block {long_key} 0 {long_digits} 0 {uuid} 0 tree {hex}""",
}


def _examples(seed: int = 5, each: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Labelled examples: what each generator proposes in lines of _LINES, every line drawn `each` times."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[r.integers(len(x))]
    of = lambda signs, n: "".join(r.choice(list(signs), int(n)))
    number = lambda n: of("0123456789", n)
    low, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    signs = low + low.upper() + "0123456789"
    words = lambda n, sep: sep.join(of(low, r.integers(3, 9)) for _ in range(n))

    def iban(shift: int) -> str:
        body, country = number(18), pick("DE", "FR", "ES", "GB")
        rest = int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        return f"{country}{(98 - rest + shift - 2) % 97 + 2:02d}{body}"

    def long(signs: str) -> str:
        return of(signs, pick(100, 201, 400, 1500, 5000))

    draw = {
        "phone": lambda: pick(f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"{number(4)} {number(3)} {number(3)}"),
        "area": lambda: pick(f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}"),
        "count": lambda: pick(f"{number(2)} {number(3)} {number(3)}", f"{number(3)} {number(3)} {number(3)}", f"20{number(2)} {number(4)} {number(3)}"),
        "years": lambda: f"19{number(2)} 19{number(2)} 20{number(2)}",
        "ssn": lambda: f"{pick('1', '2', '3', '4', '5')}{number(2)}-{pick('12', '34', '77')}-{pick('1', '5', '8')}{number(3)}",
        "serial": lambda: pick(f"{number(3)}-{number(2)}-{number(4)}", f"000-{number(2)}-{number(4)}", f"9{number(2)}-00-{number(4)}"),
        "iban": lambda: iban(0), "near_iban": lambda: iban(int(r.integers(1, 90))),
        "ipv6": lambda: ":".join(f"{x:x}" for x in r.integers(4096, 65536, 8)), "clock": lambda: ":".join(f"{x:02d}" for x in r.integers(0, 60, 3)), "mac": lambda: ":".join(f"{x:02x}" for x in r.integers(0, 256, 6)),
        "key": lambda: pick(of(hexes, pick(32, 40, 64)), of(signs, pick(20, 24, 36, 48)), of(signs + "+/", pick(40, 86)) + pick("", "=", "==")),
        "prefixed": lambda: pick("sk-", "pk_live_", "ghx_", "xoxb-", "AKIA") + of(signs, pick(24, 36, 48)),
        "jwt": lambda: f"{of(signs + '_-', 36)}.{of(signs + '_-', pick(40, 200, 900))}.{of(signs + '_-', 43)}",
        "long_key": lambda: long(pick(signs + "_-+/", hexes)), "long_word": lambda: long(low), "long_digits": lambda: long("0123456789"),
        "hex": lambda: of(hexes, pick(32, 40, 64)), "path": lambda: words(pick(4, 6), "/") + pick("", f"/{number(4)}/x"), "camel": lambda: "".join(w.capitalize() for w in words(5, " ").split()), "snake": lambda: words(pick(4, 6), "_"),
        "word": lambda: of(low, pick(20, 26, 34)), "upper": lambda: of(low.upper(), 24), "digits": lambda: number(pick(20, 24, 30)), "dashes": lambda: pick("-", "_", "/") * int(pick(20, 60, 90)), "bases": lambda: of("ACGT", pick(30, 80)),
        "uuid": lambda: "-".join(of(hexes, n) for n in (8, 4, 4, 4, 12)),
    }
    rows, labels = [], []
    for kind, lines in _LINES.items():
        pattern = re.compile(_ADDED[kind])
        for mark, line in re.findall(r"(?:^|(?<=\s))([01]) (.+?)(?=\s[01] |\s*$)", lines, re.S):
            before, name, after = re.fullmatch(r"(.*?)\{(\w+)\}(.*)", line.strip(), re.S).groups()
            for _ in range(each):
                said = pick("", "and then ", "we have ", "x = 1; ", "\n") + before
                text = said + draw[name]() + after
                for m in pattern.finditer(text):
                    if m.end() > len(said) and m.start() <= len(said):  # what is drawn, not what stands beside it
                        rows.append(_row(kind, text[: m.start()], m[0]))
                        labels.append(int(mark))
    return np.array(rows, float), np.array(labels, float)


class Booster:
    """Gradient boosting of regression trees on the logistic loss."""

    def __init__(self, rounds: int = 24, depth: int = 4, rate: float = 0.4, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.penalty = rounds, depth, rate, penalty
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            f += self._apply(tree, x)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
        leaf = (round(float(self.rate * g.sum() / (h.sum() + self.penalty)), 9),)
        if depth == 0 or len(g) < 8:
            return leaf
        gain = lambda a, b: a * a / (b + self.penalty)
        best = (gain(g.sum(), h.sum()) + 1e-6, -1, 0.0)
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, cg, ch = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                both = gain(cg[cut], ch[cut]) + gain(cg[-1] - cg[cut], ch[-1] - ch[cut])
                i = int(np.argmax(both))
                if both[i] > best[0] + 1e-9:
                    best = (float(both[i]), k, float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[1] < 0:
            return leaf
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[low], g[low], h[low], depth - 1), self._grow(x[~low], g[~low], h[~low], depth - 1)

    def _apply(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        low = x[:, tree[0]] <= tree[1]
        return np.where(low, self._apply(tree[2], x), self._apply(tree[3], x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._apply(t, x) for t in self.trees)

    def column(self, features: Column) -> Column:
        """The margin of a struct of features."""

        def of(tree: tuple) -> Column:
            if len(tree) == 1:
                return F.lit(tree[0])
            return F.when(features[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + of(t)
        return total


#: Of the choices that a kind's threshold makes on calibrating lines, so many are right at least.
PRECISION = 0.99


@functools.lru_cache(maxsize=1)
def model() -> tuple[Booster, dict[str, float]]:
    """The trees, and for each added kind the lowest margin above which PRECISION of the choices on fresh lines are right."""
    booster = Booster().fit(*_examples())
    x, y = _examples(seed=6)
    margin, limits = booster.margin(x), {}
    for kind in ADDED_KINDS:
        own = x[:, 0] == KINDS.index(kind)
        m, t = margin[own], y[own]
        steps = np.unique(m)[::-1]
        right = np.array([t[m >= v].mean() for v in steps])
        good = np.flatnonzero(right >= PRECISION)
        lowest = len(good) and good[-1]
        # Halfway to the next lower margin, where there is one.
        limits[kind] = float("inf") if not len(good) else float(steps[lowest] + steps[lowest + 1]) / 2 if lowest + 1 < len(steps) else float(steps[lowest]) - 1
    return booster, limits


def _checked_column(kind: str, value: Column) -> Column:
    if kind == "national_id":
        return ~value.rlike("^(?:000|666|9)") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")
    if kind == "iban":
        plain = F.replace(value, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
        signs = F.transform(F.regexp_extract_all(turned, F.lit("[0-9A-Z]"), F.lit(0)), lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
        rest = F.aggregate(signs, F.lit(0), lambda acc, s: F.when(s > 9, (acc * 100 + s) % 97).otherwise((acc * 10 + s) % 97))
        return rest == 1
    return F.lit(False)


def _features(kind: str, raw: Column, x: Column) -> Column:
    value = x["value"]
    since = F.greatest(F.lit(0), x["from"] - CONTEXT)
    before = F.substring(raw, (since + 1).cast("int"), (x["from"] - since).cast("int")).cast("string")
    number = lambda c: c.cast("double")
    count = lambda pattern: F.size(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)))
    letters, upper = F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.length(F.regexp_replace(value, "[^A-Z]", ""))
    distinct = sum((F.contains(value, F.lit(d)).cast("int") for d in "123456789"), F.contains(value, F.lit("0")).cast("int"))
    parts = [F.lit(float(KINDS.index(kind))), number(before.rlike(_CUE[kind])), number(before.rlike(_AGAINST[kind])), number(F.length(value)), number(F.length(_digits(value))), number(distinct), number(letters), number((upper > 0) & (upper < letters)), number(count("[0-9](?=[A-Za-z])")), number(count("[0-9A-Za-z]+")), number(_checked_column(kind, value))]
    return F.struct(*(p.alias(n) for p, n in zip(parts, FEATURES, strict=True)))


def _listed(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["from"].alias("from"), x["to"].alias("to")))


def _chosen_of(kind: str, raw: Column, booster: Booster, limit: float) -> Callable[[Column], Column]:
    """Candidates above the limit; the text's bytes and each candidate's features are computed once."""
    good = lambda x, b: _bound(_features(kind, b, x), lambda f: booster.column(f) > limit)
    return lambda candidates: F.when(F.size(candidates) == 0, candidates).otherwise(_bound(raw, lambda b: F.filter(candidates, lambda x: good(x, b))))


def _ends(sorted_spans: Column) -> Column:
    """The largest end, in bytes, up to each of the sorted spans."""
    return _running(sorted_spans, F.lit(0), lambda acc, x: F.greatest(acc, F.when(x["counts"], x["to"]).otherwise(F.lit(0).cast("bigint"))), "bigint")


def _joined_by(more: Column) -> Callable[[Column], Column]:
    """Spans and those of `more`, which don't overlap each other, that overlap none of them: one sort and one scan.

    A span overlaps an earlier one if the largest end before it lies beyond its start, and a later one only if the next
    in order begins before its end.
    """
    put = lambda spans, counts: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(not counts).alias("late"), F.lit(counts).alias("counts"), x["from"].alias("from"), x["to"].alias("to"), x.alias("span")))

    def scanned(order: Column) -> Column:
        return _bound(_ends(order), lambda ends: F.filter(order, lambda x, i: x["counts"] | ((F.coalesce(F.get(ends, i - 1), F.lit(0)) <= x["from"]) & ~F.coalesce(F.get(order, i + 1)["counts"] & (F.get(order, i + 1)["from"] < x["to"]), F.lit(False)))))

    both = lambda spans: _bound(F.array_sort(F.concat(put(spans, True), put(more, False))), scanned)
    return lambda spans: F.when(F.size(more) == 0, spans).otherwise(F.transform(both(spans), lambda x: x["span"]))


def with_spans(docs: DataFrame, prefix: str = "_pii") -> DataFrame:
    """docs with two more columns of sorted spans (start, rank of the kind, end, kind, from, to): <prefix>_base, and <prefix> with the chosen ones."""
    booster, limits = model()
    text = _null_safe(F.col("text"))
    out = docs.withColumns({f"{prefix}_{k}": _listed(k, c) for k, c in base_spans(text).items()})
    for k, pattern in _ADDED.items():
        may = text.rlike("[0-9A-Za-z_+/-]{20}" if k == "secret" else "[0-9]")
        candidates = F.when(may, _found(text, pattern)).otherwise(_none())
        out = out.withColumn(f"{prefix}_{k}", _listed(k, _bound(candidates, _chosen_of(k, text.cast("binary"), booster, limits[k]))))
    out = out.withColumn(f"{prefix}_base", F.array_sort(F.concat(*(F.col(f"{prefix}_{k}") for k in BASE_KINDS))))
    spans = F.col(f"{prefix}_base")
    for k in ADDED_KINDS:  # an added span gives way to base spans and to kinds listed before
        spans = _bound(spans, _joined_by(F.col(f"{prefix}_{k}")))
    out = out.withColumn(prefix, F.array_sort(spans))
    return out.drop(*(f"{prefix}_{k}" for k in ADDED_KINDS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    own = with_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")))
    counts = [F.size(f"_pii_{k}").cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return own.select("doc_id", *counts, F.sha2(_joined(F.col("_pii_base")), 256).alias("base_sha256"), _joined(F.col("_pii")).alias("spans"))


def redact(docs: DataFrame, length_column: str | None = None) -> DataFrame:
    """docs with every span replaced by its kind in square brackets; overlapping spans become one, of the first kind.

    A null text stays null. length_column, if there is one, gets the new number of code points.
    """
    columns = docs.columns
    own = "_pii"
    while any(c.startswith(own) for c in columns):
        own += "_"
    out = with_spans(docs, own)
    text, long = F.col("text").cast("string"), lambda c: c.cast("bigint")
    cut = lambda raw, begin, end: F.substring(raw, (begin + 1).cast("int"), F.greatest(F.lit(0), end - begin).cast("int")).cast("string")

    def piece(raw: Column, ends: Column, x: Column, i: Column) -> Column:
        """What stands before a span and the span's kind; nothing for a span that begins within an earlier one."""
        done = F.coalesce(F.get(ends, i - 1), long(F.lit(0)))
        return F.when(x["from"] < done, F.lit("")).otherwise(F.concat(cut(raw, done, x["from"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))

    def redacted(raw: Column) -> Column:
        ends = _running(F.col(own), F.lit(0), lambda acc, x: F.greatest(acc, x["to"]), "bigint")
        return _bound(ends, lambda e: F.concat(F.array_join(F.transform(F.col(own), lambda x, i: piece(raw, e, x, i)), ""), cut(raw, F.element_at(e, -1), long(F.octet_length(raw)))))

    done = _bound(text.cast("binary"), redacted)
    out = out.withColumn("text", F.when(F.size(own) > 0, done).otherwise(text))
    if length_column and length_column in columns:
        out = out.withColumn(length_column, F.length("text").cast(docs.schema[length_column].dataType))
    return out.select(*columns)
