"""Token-level column functions (P1 tokens, P2 token_count, P3 wildcard_ratio,
P6 valid_label, P7 unknown_label, P8 apply_label, P9 truncate)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"
# fixed value: the characters at which Python's ``str.split()`` cuts, as a Java / RE2 class
PY_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# A token is a wildcard iff the whole token is "<...>" with no '>' inside.
WILDCARD_TOKEN_RE = r"^<[^>]*>$"

# ---------------------------------------------------------------------------
# FIXED VALUES — the wildcard label vocabulary accepted from reviewers.
# ---------------------------------------------------------------------------
LABEL_VOCAB = (
    "<user.name>", "<user.uid>", "<user.email>",
    "<src_endpoint.ip>", "<src_endpoint.port>", "<src_endpoint.hostname>",
    "<dst_endpoint.ip>", "<dst_endpoint.port>", "<dst_endpoint.hostname>",
    "<auth_protocol>", "<auth_protocol_id>",
    "<http_request.url.path>", "<http_request.url.query>",
    "<http_request.http_method>",
    "<http_response.code>", "<http_response.length>",
    "<database.name>", "<database.table>", "<database.uid>",
    "<actor.user.name>", "<actor.process.name>", "<actor.process.pid>",
    "<app.name>", "<app.version>",
    "<file.path>", "<file.name>", "<file.uid>",
    "<network.bytes>", "<network.packets>",
    "<metadata.uid>", "<metadata.version>",
    "<severity>", "<status>",
    "<duration>", "<count>", "<size>",
    "<timestamp>", "<datetime>",
    "<unknown>",
)


#: Found in every text with a character of PY_SPACE other than the blank (and at control
#: characters). What is no space comes first, as ranges: a character is settled by one or two.
ODD = r"[^!-~ \xA1-\u167F\u1681-\u1FFF\u200B-\u2027\u202A-\u202E\u2030-\u205E\u2060-\u2FFF\u3001-\x{10FFFF}]"


def tokens(text: Column) -> Column:
    """Whitespace tokens (as ``str.split()`` cuts them), leading/trailing whitespace
    ignored; '' gives []. A text whose only spaces are blanks is cut at them, which is no regex."""
    cut = F.when(text.rlike(ODD), F.split(text, PY_SPACE)).otherwise(F.split(text, " "))
    return F.array_remove(cut, "")


def bare(text: Column) -> Column:
    """True without whitespace at either end."""
    odd = text.rlike(f"^{PY_SPACE}") | text.rlike(f"{PY_SPACE}\\z")
    return ~F.when(text.rlike(ODD), odd).otherwise(text.startswith(" ") | text.endswith(" "))


def token_count(text: Column) -> Column:
    """P2."""
    return F.size(tokens(text))


def wildcard_ratio(text: Column) -> Column:
    """Share of tokens equal to '<*>' (denominator at least 1)."""
    t = tokens(text)
    return F.size(F.filter(t, lambda x: x == WILDCARD)) / F.greatest(F.size(t), F.lit(1))


def is_wildcard(tok: Column) -> Column:
    return tok.rlike(WILDCARD_TOKEN_RE)


def unknown_label(template: Column) -> Column:
    """Fallback label, every '<*>' becomes '<unknown>'."""
    return F.replace(template, F.lit(WILDCARD), F.lit("<unknown>"))


def valid_label(original: Column, labeled: Column) -> Column:
    """Same token count, literals identical, each '<*>' replaced by a vocabulary label."""
    o, lab = tokens(original), tokens(labeled)
    vocab = F.array(*[F.lit(v) for v in LABEL_VOCAB])
    pairs = F.arrays_zip(o.alias("o"), lab.alias("l"))
    ok = F.forall(pairs, lambda p: F.when(p["o"] == WILDCARD, F.array_contains(vocab, p["l"]))
                  .otherwise(p["o"] == p["l"]))
    return F.coalesce((F.size(o) == F.size(lab)) & ok, F.lit(False))


def apply_label(original: Column, labeled: Column) -> Column:
    """The labeled template when valid, else the '<unknown>' fallback."""
    return F.when(labeled.isNotNull() & (labeled != "") & valid_label(original, labeled), labeled) \
        .otherwise(unknown_label(original))


def truncate(text: Column, n: int) -> Column:
    """First n characters (previews)."""
    return F.substring(text, 1, n)
