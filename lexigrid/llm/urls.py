"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm.shared import ASCII_LOWER, bound_batches, table
from pyspark.sql import functions as F

#: Terms of English, German, French and Spanish urls. One strict term rejects: it names what no clean page is about.
STRICT = tuple("""
    bordel bordell burdel camgirl camgirls casino casinos cialis desnudas enculer erotik erotica erotico erotique ficken gangbang
    gluecksspiel hentai huren kasino milf nsfw nutten porn porno pornographie pornografia pornos puta putas salope sexshop viagra warez
    xnxx xvideos xxx
""".split())
#: Soft terms by weight. A clean page may be about any one of them, like an act on sex discrimination or adult education.
HEAVY = tuple("""
    adult betting bingo cracked escort escorts fetish gambling gewinnspiel hardcore hookup jackpot keygen lottery loteria loterie lotterie
    nackt nude nudes nudist payday poker roulette ruleta scam sex sexe sexo slots striptease swinger torrents
""".split())
LIGHT = tuple("""
    abnehmen ads adserver affiliate apuesta apuestas bet bets billig bitcoin bonus cheap cheats click clickbait clic clics coupon coupons
    crack credito dating deal deals descuento descuentos discount doubleclick flirt forex free gagner ganar gewinn gratis gratuit
    gutschein hack kaufen kostenlos kredit loan loans malware mortgage offer offers ofertas oferta pharmacy pharmacie farmacia phishing
    pill pills popup prestamo prestamos promo promocion promos rabais rabatt ransomware regalo replica rencontre rencontres serial singles
    slot spam spyware teens torrent track tracker tracking verdienen wetten win winner winners
""".split())
SOFT = {**dict.fromkeys(HEAVY, 2), **dict.fromkeys(LIGHT, 1)}
#: So many distinct soft terms reject where their weights, doubled in the host, sum up to the limit.
SOFT_HITS, SOFT_LIMIT = 2, 3

#: (verdict, host, path), as the query's contract states them.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``. Only A-Z of the host are lower-cased."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.encode().translate(ASCII_LOWER).decode(), slash + path


def rule_index(rules=RULES) -> dict[str, list[tuple[str, str, str]]]:
    """Rules by host, so that a url asks once for each suffix of its host."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((verdict, host + path, path))
    return by_host


def match_rule(host: str, path: str, index) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, or None; allow wins a tie."""
    best, labels = None, host.split(".")
    for i in range(len(labels)):
        for verdict, rule, prefix in index.get(".".join(labels[i:]), ()):
            if path.startswith(prefix) and (best is None or (len(rule), verdict == "allow") > (len(best[0]), best[1] == "allow")):
                best = rule, verdict
    return best


def automaton(strict=STRICT, soft=SOFT):
    machine = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            machine.add_word(term, (kind, term))
    machine.make_automaton()
    return machine


def decoded(part: str) -> str:
    """Without percent signs' codes, lower-cased; as it is where they are no UTF-8."""
    try:
        return unquote(part, errors="strict").lower()
    except UnicodeDecodeError:
        return part.lower()


def hits(text: str, machine) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand alone: no letter touches either end; a digit, as in ``casino24``, may."""
    found: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for last, (kind, term) in machine.iter(text):
        first = last - len(term) + 1
        if not (first and text[first - 1].isalpha()) and not (last + 1 < len(text) and text[last + 1].isalpha()):
            found[kind].add(term)
    return found["strict"], found["soft"]


def weighed(url: str | None, machine, soft=SOFT) -> tuple[int, int, int]:
    """Distinct strict terms, distinct soft terms and the weight of these: each counts once, double if the host has it."""
    rest = (url or "").partition("://")[2]
    at = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    (hard, mild), (hard_tail, mild_tail) = (hits(decoded(part), machine) for part in (rest[:at], rest[at:]))
    return len(hard | hard_tail), len(mild | mild_tail), sum(2 * soft[t] for t in mild) + sum(soft[t] for t in mild_tail - mild)


def _judge(strict, soft, soft_hits, soft_limit, rules):
    def judge(batches):
        machine, index = automaton(strict, soft), rule_index(rules)
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                ruled = match_rule(host, path, index)
                n_hard, n_mild, weight = weighed(url, machine, soft)
                own = "block" if n_hard or (n_mild >= soft_hits and weight >= soft_limit) else "allow"
                rows.append((host, path, ruled[0] if ruled else None, ruled[1] if ruled else own, n_hard, n_mild, weight))
            columns = list(zip(*rows)) or [()] * 7
            arrays = [batch.column("page"), *(pa.array(c, pa.string()) for c in columns[:4]), *(pa.array(c, pa.int64()) for c in columns[4:])]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"])

    return judge


def judge_urls(df: DataFrame, page: str = "page_id", url: str = "url", strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS, soft_limit: int = SOFT_LIMIT, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight: one row for each row of ``df``.

    Null urls, and those without ``://``, have empty host and path, fit no rule, hold no terms
    and are allowed. Null and repeated ids stay as they are; other columns are not read.
    """
    bound_batches(df.sparkSession, 10_000)
    picked = df.select(F.col(page).cast("long").alias("page"), F.col(url).cast("string").alias("url"))
    return picked.mapInArrow(_judge(strict, soft, soft_hits, soft_limit, rules), "page_id bigint, host string, path string, rule string, verdict string, n_strict bigint, n_soft bigint, soft_weight bigint")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _alone(term: str) -> str:
    """In RE2: the term between characters that are no letters."""
    return rf"(^|[^\p{{L}}]){term}($|[^\p{{L}}])"


def _sql() -> str:
    held = lambda t: f"(regexp_matches(host_text, '{_alone(t)}') OR regexp_matches(tail, '{_alone(t)}'))"
    hard, mild = (" + ".join(f"CAST({held(t)} AS BIGINT)" for t in terms) for terms in (STRICT, SOFT))
    weight = " + ".join(f"CASE WHEN regexp_matches(host_text, '{_alone(t)}') THEN {2 * w} WHEN regexp_matches(tail, '{_alone(t)}') THEN {w} ELSE 0 END" for t, w in SOFT.items())
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS full_rest FROM pages),
p AS (SELECT page_id, full_rest, regexp_extract(full_rest, '^[^/?#]*') AS host_part FROM u),
s AS (
  SELECT page_id, lower(coalesce(TRY(url_decode(host_part)), host_part)) AS host_text,
    lower(coalesce(TRY(url_decode(substr(full_rest, length(host_part) + 1))), substr(full_rest, length(host_part) + 1))) AS tail,
    translate(host_part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(full_rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES {rules}) AS t(verdict, rule_host, rule_path)),
m AS (
  SELECT s.page_id, r.verdict, r.rule_host || r.rule_path AS rule,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC, r.verdict) AS rn
  FROM s JOIN r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)),
t AS (SELECT *, {hard} AS n_strict, {mild} AS n_soft, CAST({weight} AS BIGINT) AS soft_weight FROM s)
SELECT t.page_id, t.host, t.path, m.rule,
  coalesce(m.verdict, CASE WHEN t.n_strict > 0 OR (t.n_soft >= {SOFT_HITS} AND t.soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
  t.n_strict, t.n_soft, t.soft_weight
FROM t LEFT JOIN m ON t.page_id = m.page_id AND m.rn = 1
"""


OP9_SQL = _sql()
