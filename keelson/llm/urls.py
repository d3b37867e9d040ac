"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A term counts where no letter or digit A-Z, 0-9 stands on either side; one of
under SHORT characters only where a hyphen, dot, underscore or end of the url
stands on both, as it may well be a parameter or a number.  One strict term rejects; so do soft terms, if at least SOFT_TERMS different ones
occur and their weights sum to SOFT_WEIGHT.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import in_arrow

#: (host and path, verdict); a rule fits its host and all subdomains if the url's path starts with its own. The longest wins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
# Words of the kinds of site that a text corpus leaves out.  A strict one is enough; soft ones have a place in
# clean urls too, and count by weight.
STRICT = (
    "porn", "porno", "pornography", "xxx", "hentai", "milf", "bdsm", "camgirl", "camgirls", "camsex", "sexcam", "sexshop", "nudist", "escorts", "escort-service",
    "warez", "keygen", "keygens", "nulled", "serialz", "crackz", "viagra", "cialis", "levitra", "tramadol", "xanax", "phentermine",
    "malware", "phishing", "spyware", "adware", "linkfarm", "popunder", "onlinecasino", "sportsbook",
)
SOFT = {
    # adult
    "adult": 1.25, "sex": 2.0, "sexy": 1.25, "nude": 1.5, "nudes": 1.5, "erotic": 1.5, "erotica": 1.5, "fetish": 1.5, "webcam": 0.75, "cams": 0.75, "escort": 1.25,
    "dating": 0.75, "hookup": 1.25, "singles": 0.5, "babes": 1.0, "lingerie": 0.5, "hot": 0.5, "x": 0.75, "rated": 0.5, "18": 0.5,
    # gambling
    "casino": 1.5, "casinos": 1.5, "poker": 1.0, "betting": 1.25, "bet": 1.0, "bets": 1.25, "bookmaker": 1.0, "bookmakers": 1.0, "gambling": 1.25, "jackpot": 1.0,
    "roulette": 1.0, "blackjack": 1.0, "slot": 0.5, "slots": 1.0, "spins": 0.75, "lotto": 0.75, "lottery": 0.75, "wager": 0.75, "odds": 0.5, "win": 0.5, "winner": 0.5,
    "winners": 0.5, "prize": 0.5, "bonus": 0.5,
    # pills
    "pills": 1.5, "pill": 1.25, "pharmacy": 0.75, "pharma": 0.5, "meds": 1.25, "drugs": 0.75, "steroids": 1.25, "prescription": 0.5, "diet": 0.5, "slimming": 0.75,
    # copies without leave
    "torrent": 1.0, "torrents": 1.0, "crack": 0.75, "cracked": 1.0, "cracks": 1.0, "serial": 0.5, "serials": 0.75, "pirate": 1.0, "pirated": 1.25, "rip": 0.5,
    "mp3": 0.5, "download": 0.5, "downloads": 0.5, "full": 0.25, "movies": 0.5,
    # advertisements and spam
    "spam": 1.5, "ads": 1.25, "ad": 0.75, "adserver": 1.5, "banner": 0.5, "banners": 0.75, "popup": 1.0, "popups": 1.0, "affiliate": 0.75, "affiliates": 0.75,
    "track": 0.75, "tracker": 0.75, "trackers": 0.75, "tracking": 0.75, "clicks": 0.75, "click": 0.5, "traffic": 0.5, "seo": 0.75, "backlink": 0.75, "backlinks": 1.0,
    "doorway": 1.0, "farm": 0.5, "farms": 0.5,
    # money and sales
    "loan": 0.75, "loans": 1.0, "payday": 1.25, "debt": 0.5, "forex": 0.75, "crypto": 0.5, "bitcoin": 0.5, "cash": 0.5, "money": 0.5, "rich": 0.5, "mlm": 1.0,
    "free": 0.75, "cheap": 0.75, "cheapest": 0.75, "discount": 0.5, "replica": 1.25, "replicas": 1.25, "fake": 0.75, "buy": 0.5, "sale": 0.5, "deal": 0.25, "deals": 0.5,
    "wholesale": 0.5, "coupon": 0.5, "coupons": 0.5, "easy": 0.25, "instant": 0.25, "guaranteed": 0.5,
}
SOFT_TERMS, SOFT_WEIGHT, SHORT = 2, 2.0, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path: after the first `://`.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_WORD, _JOINT = frozenset(_LOWER + "0123456789"), frozenset("-._")


def host_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    url = F.coalesce(url, F.lit(""))
    host, path = (F.regexp_extract(url, URL, i) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = None, None
    for name, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, rest = name.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(name)) if rule is None else rule.when(fits, F.lit(name))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"),) * 2


class Vocabulary:
    """Terms in an Aho-Corasick automaton, built where it is used."""

    def __init__(self, strict=STRICT, soft=None):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for t in strict:
            self.auto.add_word(t, (t, None))
        for t, w in (SOFT if soft is None else soft).items():
            if t not in strict:
                self.auto.add_word(t, (t, w))
        self.empty = not len(self.auto)
        self.auto.make_automaton()

    def judge(self, url: str) -> tuple[int, int, float]:
        """Different strict and soft terms of a url whose A-Z are lower-cased, and the soft ones' weight."""
        if self.empty:
            return 0, 0, 0.0
        found = {}
        for end, (term, weight) in self.auto.iter(url):
            start = end - len(term)
            sides = [url[i] for i in (start, end + 1) if 0 <= i < len(url)]
            if all(c in _JOINT if len(term) < SHORT else c not in _WORD for c in sides):
                found[term] = weight
        soft = [w for w in found.values() if w is not None]
        return len(found) - len(soft), len(soft), sum(soft)


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight) for every row of pages.

    A null or empty url has no host, rule or term and is allowed.  Repeated
    rows are judged one by one; a url of any length is read whole; of rules of
    one length the first by code point counts.  Other columns of pages are not
    read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(strict, soft)
        for b in batches:
            n = [v.judge(u or "") for u in b.column(b.schema.get_field_index("low")).to_pylist()]
            hits = [pa.array([x[i] for x in n], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *hits], ["page_id", "host", "path", "rule", "said", "strict_hits", "soft_hits", "soft_weight"])

    host, path = host_path(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.translate("url", _UPPER, _LOWER).alias("low"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), "low")
    got = in_arrow(p, run, "page_id long, host string, path string, rule string, said string, strict_hits long, soft_hits long, soft_weight double")
    bad = (F.col("strict_hits") > 0) | ((F.col("soft_hits") >= SOFT_TERMS) & (F.col("soft_weight") >= SOFT_WEIGHT))
    verdict = F.coalesce("said", F.when(bad, "block").otherwise("allow")).alias("verdict")
    return got.select("page_id", "host", "path", "rule", verdict, "strict_hits", "soft_hits", "soft_weight")


def op8_url_vocabulary(spark, sf_dir: str) -> DataFrame:
    """Blocked by a rule, else by the vocabulary; pages of more than one soft term or a strict one that no rule covers are blocked."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    def hit(term: str) -> str:
        edge = "[-._]" if len(term) < SHORT else "[^a-z0-9]"
        return f"regexp_matches(low, '(^|{edge}){term}({edge}|$)')"

    def fits(name: str) -> str:
        at, _, rest = name.partition("/")
        return f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}')"

    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[i]}'" for r in ordered) + " END"
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{URL}', 2) AS path, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low FROM pages),
h AS (SELECT *, {case(0)} AS rule, {case(1)} AS said,
  CAST({' + '.join(f'CAST({hit(t)} AS INT)' for t in STRICT)} AS BIGINT) AS strict_hits,
  CAST({' + '.join(f'CAST({hit(t)} AS INT)' for t in SOFT)} AS BIGINT) AS soft_hits,
  CAST({' + '.join(f'{w} * CAST({hit(t)} AS INT)' for t, w in SOFT.items())} AS DOUBLE) AS soft_weight FROM u)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN strict_hits > 0 OR (soft_hits >= {SOFT_TERMS} AND soft_weight >= {SOFT_WEIGHT})
  THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits, soft_weight FROM h
"""


SQL = _sql()
