"""Personal data by candidate gradient boosting, in DataFrame functions alone (operator 1).

Strict patterns give the base spans, which always stay.  High-recall generators propose more
spans, overlapping ones too: local and spaced phone numbers, numbers with card digits in
other groupings or with a wrong check digit, IPv6 addresses, e-mail addresses with written-out
signs, and secrets: values that follow a name such as ``token =``, and long runs of mixed
letters and digits.  Boosted trees over format and context features score each proposal; those
over a calibrated threshold that touch no base span, and no better proposal, are added (of
equal scores, the one that starts first, then by kind and end).  The trees are trained on the
driver with TRAIN_ROWS labelled sentences made from templates, whose features the same
expressions give; words around the numbers of the quarter that sets the threshold are others
than those that the trees have seen.  The trees are then one column expression, so that all
rows stay in the JVM.

Positions are code points, ends exclusive.  All patterns with a gap begin at the end of the
match before (\\G), so a text is read once for each, whatever its length.

Rows: a null or empty text has no spans; texts of any length are read whole; repeated rows
and null ids each give a row; an empty table gives an empty table; columns other than the id
and the text are not read.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that have base patterns.
BASE = KINDS[:4]
# The base patterns.  Each begins where its run of characters does, or right after the match before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Runs of the characters of numbers, seven or more; shorter ones hold no span and go with the gap.
NUMBERS = r"(?s)\G((?:[^0-9+(]++|[0-9+(][0-9().\x20+-]{0,5}+(?![0-9().\x20+-]))*+)([0-9+(][0-9().\x20+-]{6,}+)"

# Generators of proposals.
WRITTEN_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]++)++"
IPV6 = r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Fa-f:])"
LOCAL_PHONE = r"(?:\G|(?<![0-9]))(?:\([0-9]{2,5}+\)|[0-9]{2,5}+)(?:[\x20./-]{1,2}+[0-9]{2,5}+)++(?![0-9])"
ODD_CARD = r"(?:\G|(?<![0-9]))[0-9]{3,6}+(?:[\x20.-]{1,3}+[0-9]{3,7}+){2,}+(?![0-9])"
CARD_RUN = r"(?:\G|(?<![0-9]))[0-9]{12,19}+(?![0-9])"
# Names whose value is a secret.
SECRET_NAMES = "(?i:token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|private|secret)[_-]?key|auth|bearer|credentials?)"
ASSIGNED = rf"(?<={SECRET_NAMES}[\"']?\x20?(?:=|:|=>)\x20?[\"']?)[^\x20\x09-\x0D\"'=:>][^\x20\x09-\x0D\"',;]{{5,}}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}+"

#: Labelled sentences that the trees learn from; a quarter sets the threshold.
TRAIN_ROWS = 4000
ROUNDS = 60
SHRINK = 0.3
#: Share of the proposals over the threshold that have to be right on the held-out quarter.
PRECISION = 0.99
#: Code points of context that features look at before a proposal.
CONTEXT = 32

SPAN = "struct<start:int,end:int,s:string>"


def located(text: Column, pattern: str, gap: str | None = None) -> Column:
    """array<SPAN> of the matches of ``pattern``, leftmost first, none overlapping."""
    full = gap or rf"(?s)\G(.*?)({pattern})"
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(full), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(full), F.lit(2)).alias("hit"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
        F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("s"))).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def within(regions: Column, pattern: str, needs: str) -> Column:
    """Matches inside regions that hold ``needs``, placed in the text."""
    found = F.transform(
        F.filter(regions, lambda r: r["s"].rlike(needs)),
        lambda r: F.transform(located(r["s"], pattern), lambda x: F.struct((x["start"] + r["start"]).alias("start"), (x["end"] + r["start"]).alias("end"), x["s"].alias("s"))),
    )
    return F.flatten(found)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has the right check digit."""
    back = F.reverse(d)
    at = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(d))), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, at(i)).when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2),
    )
    return F.coalesce(total % 10 == 0, F.lit(False))


def valid_ip(s: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


def valid_card(s: Column) -> Column:
    return F.length(digits(s)).between(12, 19) & luhn(F.substring(digits(s), 1, 19))


def valid_phone(s: Column) -> Column:
    return F.length(digits(s)).between(9, 15)


def tagged(spans: Column, kind: str) -> Column:
    """array<struct<start, kind_no, end>> of spans of one kind."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), x["end"].alias("end")))


def empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def base_spans(df: DataFrame) -> DataFrame:
    """``text`` with its number regions and the base spans of each kind."""
    df = df.withColumn("regions", located(F.col("text"), "", NUMBERS))
    return df.select(
        "*",
        F.when(F.contains("text", F.lit("@")), located(F.col("text"), EMAIL)).otherwise(empty()).alias("b_email"),
        F.filter(within(F.col("regions"), IP, r"[0-9]\.[0-9]"), lambda x: valid_ip(x["s"])).alias("b_ip"),
        F.filter(within(F.col("regions"), CARD, r"(?:[0-9][\x20-]?){11}[0-9]"), lambda x: valid_card(x["s"])).alias("b_card"),
        F.filter(within(F.col("regions"), PHONE, r"\+[0-9]"), lambda x: valid_phone(x["s"])).alias("b_phone"),
    )


def proposals() -> dict[str, tuple[str, Column]]:
    """generator: (kind, its spans); expects the columns of ``base_spans``."""
    text, regions = F.col("text"), F.col("regions")
    return {
        "written": ("email", F.when(text.rlike(r"(?i)[\x20\[({]at[\x20\])}]|[\[({]@") & text.rlike(r"(?i)[\x20\[({]dot[\x20\])}]|\]\x20?[A-Za-z0-9-]+\."), located(text, WRITTEN_EMAIL)).otherwise(empty())),
        "ipv6": ("ip", F.when(text.rlike(r":[0-9A-Fa-f]{0,4}:"), located(text, IPV6)).otherwise(empty())),
        "odd_card": ("card", within(regions, ODD_CARD, r"[0-9][\x20.-]+[0-9]")),
        "card_run": ("card", within(regions, CARD_RUN, r"[0-9]{12}")),
        "local": ("phone", within(regions, LOCAL_PHONE, r"[0-9)][\x20./-]+[0-9]")),
        "assigned": ("secret", F.when(text.rlike(rf"{SECRET_NAMES}[\"']?\x20?[=:]"), located(text, ASSIGNED)).otherwise(empty())),
        "token": ("secret", F.when(text.rlike(r"[A-Za-z+/_-][0-9][A-Za-z0-9+/_-]{5}|[0-9][A-Za-z+/_-][A-Za-z0-9+/_-]{5}"), located(text, TOKEN)).otherwise(empty())),
    }


# Words before a number or address that speak for or against a kind.
WORDS_FOR = {
    "email": r"(?i)(?:mail|contact|reach|write|kontakt|correo|adresse)",
    "ip": r"(?i)(?:\bip|host|server|address|addr|login|client|peer)",
    "card": r"(?i)(?:card|visa|credit|debit|amex|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|contact|ring|anruf|llam|appel)",
    "secret": r"(?i)(?:token|secret|passw|passphrase|pwd|key|auth|bearer|credential)",
}
WORDS_AGAINST = r"(?i)(?:isbn|issn|order|invoice|version|ver\.|page|pages|chapter|date|serial|ticket|case|article|model|since|from|until|score|time|usd|eur|\$|€|£|#|%|commit|sha-?[0-9]|md5|hash|uuid|digest|checksum|etag|build|revision)"


def features() -> dict:
    """Feature name: expression over a proposal x (kind_no, gen_no, s, left, right)."""
    count = lambda x, cls: F.length(x["s"]) - F.length(F.regexp_replace(x["s"], cls, ""))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    says = lambda x, k: flag((x["kind_no"] == KINDS.index(k)) & x["left"].rlike(WORDS_FOR[k]))
    return {
        "kind_no": lambda x: x["kind_no"],
        "length": lambda x: F.length(x["s"]),
        "n_digits": lambda x: count(x, "[0-9]"),
        "n_hex": lambda x: count(x, "[A-Fa-f]"),
        "n_colons": lambda x: count(x, ":"),
        "n_brackets": lambda x: count(x, r"[\[\](){}]"),
        "n_dots": lambda x: count(x, r"\."),
        "n_groups": lambda x: F.size(F.split(x["s"], "[^0-9A-Za-z]+")),
        "ends_phone": lambda x: flag(x["s"].rlike(r"[0-9]{3}[\x20.-][0-9]{4}$")),
        "fours": lambda x: flag(x["s"].rlike(r"^(?:[0-9]{4}[^0-9]+){3}[0-9]{4}$|^[0-9]{4}[^0-9]+[0-9]{6}[^0-9]+[0-9]{5}$")),
        "luhn": lambda x: flag((x["kind_no"] == KINDS.index("card")) & luhn(digits(x["s"]))),
        "n_upper": lambda x: count(x, "[A-Z]"),
        "changes": lambda x: F.size(F.split(x["s"], "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")),
        "assigned": lambda x: flag(x["left"].rlike(r"[=:>]\x20?[\"']?$")),
        "quoted": lambda x: flag(x["left"].rlike("[\"']$") & x["right"].rlike("^[\"']")),
        "uuid": lambda x: flag(x["s"].rlike("^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")),
        "in_url": lambda x: flag(x["left"].rlike(r"(?:://|www\.)[^\x20\x09-\x0D]*$")),
        "like_date": lambda x: flag(x["s"].rlike(r"^(?:19|20)[0-9]{2}[./-][0-9]{1,2}|[./-](?:19|20)[0-9]{2}$|^(?:19|20)[0-9]{2}[\x20-]+(?:19|20)[0-9]{2}$")),
        "like_time": lambda x: flag(x["s"].rlike(r"^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?$|^[0-9]{1,2}:[0-9]{2}:[0-9]{2}:[0-9]{1,2}$")),
        "top_domain": lambda x: flag(x["s"].rlike(r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$")),
        "for": lambda x: sum((says(x, k) for k in KINDS[1:]), says(x, KINDS[0])),
        "against": lambda x: flag(x["left"].rlike(WORDS_AGAINST)),
        "glued": lambda x: flag(x["left"].rlike(r"[0-9A-Za-z$€£#.,:/-]$")) + flag(x["right"].rlike(r"^[0-9A-Za-z%:/-]|^[.,][0-9]")),
    }


def candidates(df: DataFrame) -> Column:
    """array of all proposals with their context, by start; expects the columns of ``base_spans``."""
    text = F.col("text")
    before = lambda x: F.substring(text, F.greatest(F.lit(1), x["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), x["start"]))
    def of(kind: str, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(
                x["start"].alias("start"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind_no"), x["s"].alias("s"),
                before(x).alias("left"), F.substring(text, x["end"] + 1, F.lit(4)).alias("right"),
            ),
        )

    return F.concat(*[of(*x) for x in proposals().values()])


class Trees:
    """Boosted trees of depth two over small integer features, by second-order logistic gain."""

    def __init__(self) -> None:
        self.trees: list[tuple] = []
        self.bias = 0.0
        self.threshold = 0.0

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        best = (0.0, -1, 0)
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= v
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
                if gain > best[0] + 1e-9:
                    best = (gain, f, int(v))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        score = np.full(len(y), self.bias)
        value = lambda g, h: float(-SHRINK * g.sum() / (h.sum() + 1.0))
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            _, f, v = self._split(x, g, h)
            if f < 0:
                break
            sides = []
            for side in (x[:, f] <= v, x[:, f] > v):
                _, f2, v2 = self._split(x[side], g[side], h[side])
                if f2 < 0:
                    leaf = value(g[side], h[side])
                    sides.append((0, v, leaf, leaf))
                    score[side] += leaf
                else:
                    low, high = side & (x[:, f2] <= v2), side & (x[:, f2] > v2)
                    leaves = value(g[low], h[low]), value(g[high], h[high])
                    sides.append((f2, v2, *leaves))
                    score[low] += leaves[0]
                    score[high] += leaves[1]
            self.trees.append((f, v, *sides))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, v, low, high in self.trees:
            for side, (f2, v2, a, b) in ((x[:, f] <= v, low), (x[:, f] > v, high)):
                out += side * np.where(x[:, f2] <= v2, a, b)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """The lowest threshold over which PRECISION of the rows are right."""
        s = self.score(x)
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        last = np.diff(np.append(s[order], -np.inf)) < 0  # a threshold can't part equal scores
        good = np.flatnonzero((right >= PRECISION) & last)
        self.threshold = float(s[order][good[-1]]) if len(good) else float("inf")
        return self

    def expression(self, x: Column, names: list[str]) -> Column:
        """The score as a column expression over a struct of features."""
        of = lambda k: x[names[k]]
        total = F.lit(self.bias)
        for f, v, low, high in self.trees:
            leaf = lambda t: F.when(of(t[0]) <= t[1], F.lit(t[2])).otherwise(F.lit(t[3]))
            total = total + F.when(of(f) <= v, leaf(low)).otherwise(leaf(high))
        return total


def sentences(seed: int = 11) -> list[tuple[str, int]]:
    """TRAIN_ROWS sentences with one number, address or key each, and the kind of personal data that it is, or -1.

    Of ten sentences in turn, every fourth ten has other words around the number than the rest.
    """
    rng = random.Random(seed)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k - 2)) + "k7"
    word = lambda: rng.choice("anna john info sales peter.m j.doe kim support m_rossi lee42".split())
    site = lambda: rng.choice("example mail acme my-shop firma correo".split())
    top = lambda: rng.choice("com org net de fr es io".split())

    def card(joints: list[str]) -> str:
        d = rng.choice("3456") + n(14)
        total = sum(int(c) if k % 2 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d))
        d += str(-total % 10)
        return rng.choice(joints).join(d[k : k + 4] for k in range(0, 16, 4))

    def wrong(joints: list[str]) -> str:
        right = card(joints)
        return right[:-1] + str((int(right[-1]) + rng.randrange(1, 10)) % 10)

    secret = lambda: rng.choice([hexa(40), hexa(32), hexa(64), mixed(20), mixed(32), mixed(24), f"sk-{mixed(32)}", f"ghp_{mixed(36)}", f"AKIA{mixed(16).upper()}"])
    named = lambda: rng.choice(["token", "secret", "password", "api_key", "API_KEY", "access-key", "auth", "pwd"])
    assigned = lambda v: rng.choice([f'{named()} = "{v}"', f"{named()}: {v}", f"{named()}={v}", f"{named()} = '{v}'"])
    good = {
        "email": lambda: rng.choice([f"{word()} [at] {site()} [dot] {top()}", f"{word()}(at){site()}(dot){top()}", f"{word()} at {site()} dot {top()}", f"{word()} AT {site()} DOT {top()}", f"{word()}[at]{site()}.{top()}"]),
        "ip": lambda: rng.choice([":".join(hexa(4) for _ in range(8)), f"2001:db8::{hexa(4)}:{hexa(3)}", f"fe80::{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}"]),
        "card": lambda: card([".", " - ", "  ", ". "]),
        "phone": lambda: rng.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)} {n(3)} {n(4)}", f"({n(3)}) {n(3)}.{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"0{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(2)} {n(4)} {n(4)}"]),
        "secret": lambda: assigned(rng.choice([secret, secret, lambda: f"{word()}{n(3)}!{mixed(4)}"])()),
    }
    bad = [
        lambda: f"{rng.choice(['19', '20'])}{n(2)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", lambda: f"{rng.randrange(1, 29):02}.{rng.randrange(1, 13):02}.20{n(2)}",
        lambda: f"19{n(2)} - 20{n(2)}", lambda: f"{n(2)}:{n(2)}:{n(2)}", lambda: f"{n(1)}.{n(2)}.{n(3)}-{n(2)}", lambda: f"978-{n(1)}-{n(3)}-{n(5)}-{n(1)}", lambda: f"{n(4)} {n(4)}",
        lambda: f"{n(3)} {n(3)}", lambda: f"{n(3)} {n(3)} {n(3)}", lambda: f"{n(5)}-{n(4)}", lambda: f"{n(2)}-{n(2)}", lambda: f"{n(4)}.{n(4)}.{n(4)}.{n(4)}.{n(4)}", lambda: f"{n(2)}:{n(2)}:{n(2)}:{n(2)}",
        lambda: f"{word()} at {site()} dot {rng.choice(['matrix', 'line', 'by', 'and', 'product'])}", lambda: f"{n(3)}.{n(3)}.{n(3)}", lambda: f"{n(4)} {n(3)} {n(2)} {n(4)}", lambda: f"{n(3)} {n(4)} {n(3)} {n(5)}",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: ".".join(str(rng.randrange(100, 256)) for _ in range(4)), lambda: wrong([""]), lambda: n(14), lambda: wrong([".", "  "]),
        lambda: f"commit {hexa(40)}", lambda: f"sha256:{hexa(64)}", lambda: f"md5 {hexa(32)}", lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: f"http://{site()}.{top()}/{mixed(24)}/{n(4)}",
        lambda: f"token-based-model-{n(4)}", lambda: f"{word()}-{site()}-version-{n(2)}", lambda: f"INV-20{n(2)}-{n(12)}", lambda: "token: the", lambda: "password: forgotten", lambda: f"auth: {rng.choice(['required', 'optional', 'disabled'])}",
    ]
    context = [
        ({"email": ["mail", "contact", "write to"], "ip": ["host", "server", "client ip"], "card": ["card", "visa", "credit card"], "phone": ["call", "tel", "phone", "fax"], "secret": ["set", "with", "export"]},
         ["order", "invoice", "version", "isbn", "pages", "date", "from", "score", "serial", "ticket", "model"], ["and the", "of them", "in", "which", "une", "und das"], ["and so on", "as before", "in the end"]),
        ({"email": ["reach us", "correo", "kontakt"], "ip": ["login address", "peer"], "card": ["payment", "tarjeta", "amex"], "phone": ["mobile", "ring", "whatsapp"], "secret": ["config", "use", "env"]},
         ["article", "chapter", "case", "until", "invoice", "since"], ["para los", "seen near", "avec", "einer", "then"], ["was noted.", "para todos", "hier"]),
    ]
    out = []
    for k in range(TRAIN_ROWS):
        ahead, against, plain, after = context[k // 10 % 4 == 3]
        if k % 2:
            kind = KINDS[k // 2 % 5]
            lead, s, label = rng.choice([*ahead[kind], *plain]), good[kind](), KINDS.index(kind)
        else:
            lead, s, label = rng.choice([*against, *plain, *plain]), rng.choice(bad)(), -1
        out.append((f"{lead}{rng.choice([' ', ': ', ' '])}{s}{rng.choice([' ', '.', ', '])}{rng.choice(after)}", label))
    return out


@lru_cache(1)
def trained(spark: SparkSession) -> tuple[Trees, list[str]]:
    """The trees, and the names of their features."""
    rows = json.dumps([{"text": t, "label": y} for t, y in sentences()])
    df = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<text:string,label:int>>"))).withColumn("row", F.monotonically_increasing_id())
    named = features()
    x = base_spans(df).select("row", "label", F.explode(candidates(df)).alias("x"))
    got = x.select("row", "label", *[f(F.col("x")).cast("int").alias(k) for k, f in named.items()]).collect()  # a few proposals for each sentence
    got.sort(key=lambda r: tuple(r))
    table = np.array([[r[k] for k in named] for r in got])
    y = np.array([r["label"] == r["kind_no"] for r in got], dtype=float)  # right in kind, too
    held = np.array([r["row"] // 10 % 4 == 3 for r in got])  # ten rows in turn have all kinds
    return Trees().fit(table[~held], y[~held]).calibrate(table[held], y[held]), list(named)


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, b_<kind>, base, spans): arrays of struct<start, kind_no, end>, by start and kind."""
    return with_spans(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")))


def with_spans(df: DataFrame) -> DataFrame:
    """``df`` with the spans of its ``text``, and what led to them."""
    trees, names = trained(df.sparkSession)
    named = features()
    df = base_spans(df.withColumn("text", F.coalesce("text", F.lit(""))))
    df = df.withColumn("base", F.array_sort(F.concat(*[tagged(F.col(f"b_{k}"), k) for k in BASE])))
    df = df.withColumn("proposed", candidates(df))
    clear = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    df = df.withColumn(
        "proposed",
        F.transform(
            F.filter("proposed", clear),
            lambda x: F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end"), F.struct(*[f(x).cast("int").alias(k) for k, f in named.items()]).alias("x")),
        ),
    )
    df = df.withColumn("proposed", F.transform("proposed", lambda x: F.struct((-trees.expression(x["x"], names)).alias("loss"), x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end"))))
    df = df.withColumn("proposed", F.array_sort(F.filter("proposed", lambda x: x["loss"] <= -trees.threshold)))
    # the best first; one that overlaps a better one goes
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    chosen = F.aggregate(
        "proposed", none,
        lambda acc, x: F.when(F.exists(acc, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])), acc).otherwise(
            F.array_append(acc, F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end")))
        ),
    )
    return df.withColumn("spans", F.array_sort(F.concat("base", chosen))).drop("proposed", "regions")


def listed(spans: str) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind_no"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the earlier one counts."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind_no"] + 1)
    part = lambda a, b: F.substring(text, a + 1, b - a)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, x: F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(part(acc["at"], x["start"]), F.concat(F.lit("["), F.upper(kind(x)), F.lit("]")))).alias("out"))
    )
    return F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), F.length(text) - acc["at"]))))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its columns as they are, but for the spans in the text; a null text stays null."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))  # names can't clash with those used here
    spans = with_spans(rows.withColumn("text", F.col("row")[text_col].cast("string")))
    text = F.when(F.col("row")[text_col].isNull(), F.lit(None).cast("string")).when(F.size("spans") == 0, F.col("row")[text_col]).otherwise(redacted(F.col("text"), F.col("spans")))
    return spans.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_spans(common.table(spark, sf_dir, "documents"))
    of = lambda no: F.size(F.filter("spans", lambda x: x["kind_no"] == no))
    added = {k: of(no) - (F.size(f"b_{k}") if k in BASE else F.lit(0)) for no, k in enumerate(KINDS)}
    return found.select(
        "doc_id", *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        *[c.cast("long").alias(f"added_{k}") for k, c in added.items()], F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("has_personal_data"),
    )
