"""Text, URL and identity functions; Python only where Spark has no expression."""

from __future__ import annotations

import functools
import html
import ipaddress
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.folding import folded_text

#: Query keys that only track.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]
#: The keyword rules of the event classifier, in order.
EVENT_RULES = [
    (["exploit", "hack", "vulnerability", "security incident"], "security_incident", 0.85),
    (["rate cut", "rate hike", "interest rate", "central bank", "fomc"], "monetary_policy", 0.65),
    (["sec ", "cftc", "regulat", "enforcement", "approval"], "regulation", 0.60),
    (["release", "version", "upgrade", "hard fork", "soft fork"], "protocol_release", 0.35),
]
#: Fixed value: what a leaked credential looks like.
SECRET = r"(?i)(authorization\s*[:=]|bearer\s+|\b(aa|sk)-[A-Za-z0-9_-]{6,})"


#: :func:`folded_text` of each row. Texts go to Python a hundred at a time and not in Arrow batches of 10,000, so a worker's memory doesn't grow with the table.
folded = F.udf(folded_text, T.StringType(), useArrow=False)


def fold(text: Column) -> Column:
    """:func:`folded`; ASCII text stays in the JVM."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[\\x09-\\x0D\\x1C-\\x20]+", " "))
    wide = text.rlike("[^\\x00-\\x7F]")
    return F.when(wide, folded(F.when(wide, text))).otherwise(plain)


@F.pandas_udf(T.StringType())
def unescaped(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else re.sub(r"\s+", " ", html.unescape(v)).strip())


@F.pandas_udf(T.StringType())
def ascii_host(x: pd.Series) -> pd.Series:
    """The IDNA form of a host, null where there is none."""

    def one(v):
        try:
            return None if v is None else v.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return x.map(one)


def tagless(markup: Column) -> Column:
    """Text without tags and without script and style bodies; entities stay."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def strip_markup(markup: Column) -> Column:
    return unescaped(tagless(markup))


@F.pandas_udf(T.BooleanType())
def global_address(x: pd.Series) -> pd.Series:
    """Whether an IP address is globally routable; true for what is no address."""

    def one(v):
        try:
            return None if v is None else ipaddress.ip_address(v).is_global
        except ValueError:
            return True

    return x.map(one)


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """The lower-case IDNA host without dots at its ends and without an IPv6 literal's brackets; '' where there is none or no valid one.

    ASCII hosts stay in the JVM."""
    authority = F.regexp_replace(_authority(F.trim(url)), "^.*@", "")
    literal = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    host = F.trim(F.lower(F.when(literal != "", literal).otherwise(F.regexp_extract(authority, "^([^:\\[]*)", 1))), F.lit("."))
    wide = host.rlike("[^\\x00-\\x7F]")
    return F.coalesce(F.when(wide, ascii_host(F.when(wide, host))).when(~host.rlike(r"(^|\.)(\.|[^.]{64})"), host), F.lit(""))


def _form_decoded(x: Column) -> Column:
    """Percent forms and plus signs decoded; stray percent signs stay."""
    return F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and IDNA host, no default port, fragment, trailing slash or tracking keys; query pairs decoded, in
    order of (key, value) and encoded again, blank values kept. Null for anything but an absolute http(s) URL with a valid host and
    port and without user information."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z]+)://", 1))
    authority, host = _authority(u), host_of(u)
    port = F.regexp_extract(authority, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
    number = F.when(port.rlike("^[0-9]{1,9}$"), port.cast("int"))
    standard = (port == "") | ((scheme == "https") & (number == 443)) | ((scheme == "http") & (number == 80))
    path = F.regexp_extract(u, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    path = F.when(path.isin("", "/"), "/").otherwise(F.rtrim(path, F.lit("/")))
    parts = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    pairs = F.transform(parts, lambda p: F.struct(_form_decoded(F.substring_index(p, "=", 1)).alias("k"), _form_decoded(value(p)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*TRACKING))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&")
    out = F.concat(scheme, F.lit("://"), host, F.when(standard, "").otherwise(F.concat(F.lit(":"), number)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (host != "") & ~authority.contains("@") & ((port == "") | (number <= 65535)), out)


def host_allowed(host: Column, domains: list[str]) -> Column:
    return functools.reduce(operator.or_, [(host == d) | host.endswith(f".{d}") for d in domains], F.lit(False))


def public_host(host: Column) -> Column:
    """Neither local nor an address that isn't globally routable."""
    address = F.when(host.rlike("^[0-9.]+$") | host.contains(":"), host)
    return (host != "") & (host != "localhost") & ~host.endswith(".localhost") & F.coalesce(global_address(address), F.lit(True))


def feed_time(text: Column, retrieved: Column, skew_s: int) -> Column:
    """RFC 822 or ISO times with a zone; null without one or when later than retrieval plus skew."""
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), " (GMT|UT|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))
    t = F.coalesce(rfc, iso)
    return F.when(F.unix_micros(t) <= F.unix_micros(retrieved) + skew_s * 1_000_000, t)


def identity(*parts: Column) -> Column:
    """SHA-256 of the parts in order, each with its length, so that no two lists share a form."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(x.cast("string"), F.lit("")) for x in parts)]), 256)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")


def classify(text: Column) -> Column:
    """struct(event_type, severity, horizon) by the first rule that matches."""
    t, found = F.lower(text), None
    for words, kind, severity in EVENT_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        value = F.struct(F.lit(kind).alias("event_type"), F.lit(severity).alias("severity"))
        found = F.when(hit, value) if found is None else found.when(hit, value)
    base = found.otherwise(F.struct(F.lit("general_update").alias("event_type"), F.lit(0.2).alias("severity")))
    return F.struct(base["event_type"].alias("event_type"), base["severity"].alias("severity"), F.when(base["severity"] >= 0.6, "1d_3d").otherwise("1w_plus").alias("horizon"))


def folded_terms(terms: list[str]) -> list[str]:
    """Terms as :func:`fold` leaves texts, each once, without empty ones."""
    return [t for t in dict.fromkeys(map(folded_text, terms)) if t]


def relevance(text: Column, include: list[str], exclude: list[str], is_folded: bool = False) -> Column:
    """struct(accepted, reason, included, excluded) of a text, folded like the terms; an excluded term beats an included one.

    The folded text is an element of an array that the terms are tested in, so it is made once per row and not once per term and use."""
    include, exclude = folded_terms(include), folded_terms(exclude)
    no = F.array().cast("array<string>")
    found = lambda t, terms: F.filter(F.array(*map(F.lit, terms)), lambda x: F.contains(t, x)) if terms else no
    hits = F.transform(F.array(F.coalesce(text if is_folded else fold(text), F.lit(""))), lambda t: F.struct(found(t, include).alias("inc"), found(t, exclude).alias("exc")))
    return F.transform(hits, lambda h: _decision(h["inc"], h["exc"], bool(include)))[0]


def _decision(inc: Column, exc: Column, needed: bool) -> Column:
    # The reasons.
    reason = F.when(F.size(exc) > 0, "rejected_excluded_term").when((F.size(inc) == 0) if needed else F.lit(False), "rejected_missing_include_term").otherwise("accepted_include_match" if needed else "accepted_no_include_terms")
    return F.struct(reason.startswith("accepted").alias("accepted"), reason.alias("reason"), inc.alias("included"), exc.alias("excluded"))


def document_text(title: Column, summary: Column) -> Column:
    return F.concat_ws("\n\n", F.substring(title, 1, 500), F.nullif(summary, F.lit("")))
