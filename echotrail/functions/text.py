"""Column expressions for text: tokens, secret and personal-data patterns, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: regex building blocks -------------------------------------------------
# Unicode white space, digits and word boundaries written out, because the JVM and RE2 read
# the short forms (\s, \d, \b) as ASCII.
JVM = {
    "ws": r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]",
    "wsi": r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}",
    "nws": r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]",
    "d": r"\p{Nd}",
    "bl": r"(?<![\p{L}\p{N}_])",
    "br": r"(?![\p{L}\p{N}_])",
    "i": "(?iu)",
}
RE2 = {
    "ws": r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]",
    "wsi": r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}",
    "nws": r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]",
    "d": r"\p{Nd}",
    "bl": r"\b",
    "br": r"\b",
    "i": "(?i)",
}


def secret_patterns(c: dict[str, str] = JVM) -> dict[str, str]:
    """The fifteen patterns that mark a text as sensitive."""
    ws, nws, i = c["ws"], c["nws"], c["i"]
    return {
        "api_key": rf"{i}(?:api[_\-]?key|api[_\-]?secret|auth[_\-]?token|access[_\-]?token|bearer){ws}*[=:]{ws}*{nws}{{8,}}",
        "aws_access_key": r"AKIA[0-9A-Z]{16}",
        "aws_secret": rf"{i}(?:aws_secret_access_key|AWS_SECRET){ws}*[=:]{ws}*{nws}+",
        "private_key": rf"-----BEGIN{ws}+(?:RSA|DSA|EC|OPENSSH|PGP)?{ws}*PRIVATE KEY-----",
        "connection_string": rf"(?:postgres|postgresql|mysql|redis|mongodb|amqp|mssql)://{nws}+:{nws}+@{nws}+",
        "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+",
        "ssh_key": rf"ssh-(?:rsa|ed25519|ecdsa){ws}+[A-Za-z0-9+/=]{{40,}}",
        "password": rf"{i}(?:password|passwd|pwd){ws}*[=:]{ws}*{nws}{{4,}}",
        "github_token": r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}",
        "gitlab_token": r"glpat-[A-Za-z0-9\-]{20,}",
        "slack_token": r"xox[bpors]-[A-Za-z0-9\-]{10,}",
        "stripe_key": r"(?:sk|pk)_(?:test|live)_[A-Za-z0-9]{20,}",
        "openai_key": r"sk-[A-Za-z0-9]{20,}",
        "google_key": r"AIza[A-Za-z0-9\-_]{35}",
        "hex_secret": rf"{i}(?:secret|key|token){ws}*[=:]{ws}*[0-9a-fA-F]{{32,}}",
    }


def redact_token_pattern(c: dict[str, str] = JVM) -> str:
    """Fixed value: the token forms that redaction replaces."""
    ws = c["ws"]
    return (
        r"(AKIA[0-9A-Z]{16}"
        r"|(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"
        r"|glpat-[A-Za-z0-9\-]{20,}"
        r"|xox[bpors]-[A-Za-z0-9\-]{10,}"
        r"|(?:sk|pk)_(?:test|live)_[A-Za-z0-9]{20,}"
        r"|sk-[A-Za-z0-9]{20,}"
        r"|AIza[A-Za-z0-9\-_]{35}"
        r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"
        rf"|ssh-(?:rsa|ed25519|ecdsa){ws}+[A-Za-z0-9+/=]{{40,}}"
        rf"|-----BEGIN{ws}+(?:RSA|DSA|EC|OPENSSH|PGP)?{ws}*PRIVATE KEY-----(?s:.)*?"
        rf"-----END{ws}+[\p{{L}}\p{{N}}_]+{ws}*PRIVATE KEY-----)"
    )


def redact_assignment_pattern(c: dict[str, str] = JVM) -> str:
    """Fixed value: ``key = value`` forms whose value redaction replaces."""
    ws, nws, i = c["ws"], c["nws"], c["i"]
    return rf"{i}((?:api[_\-]?key|password|passwd|pwd|secret|token){ws}*[=:]{ws}*){nws}+"


def pii_patterns(c: dict[str, str] = JVM) -> dict[str, str]:
    """Personal-data labels in the order in which they are replaced."""
    ws, wsi, d, bl, br, i = c["ws"], c["wsi"], c["d"], c["bl"], c["br"], c["i"]
    sep = rf"[-.{wsi}]"
    months = (
        "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
        "|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
    )
    return {
        "EMAIL": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
        "PHONE": rf"(?:\+?{d}{{1,3}}{sep}?)?\(?{d}{{3}}\)?{sep}?{d}{{3}}{sep}?{d}{{4}}",
        "SSN": rf"{bl}{d}{{3}}{sep}?{d}{{2}}{sep}?{d}{{4}}{br}",
        "DATE": (
            rf"{i}{bl}(?:{d}{{4}}{sep}{d}{{2}}{sep}{d}{{2}}|{d}{{1,2}}/{d}{{1,2}}/{d}{{2,4}}){br}"
            rf"|{bl}(?:{months}){ws}+{d}{{1,2}}(?:st|nd|rd|th)?(?:,?{ws}+{d}{{4}})?{br}"
        ),
        "NAME": rf"{bl}(?:Mr\.|Ms\.|Mrs\.|Dr\.|Prof\.){ws}+[A-Z][a-z]+(?:{ws}+[A-Z][a-z]+)?{br}",
        "IP_ADDRESS": (
            rf"{bl}(?:{d}{{1,3}}\.){{3}}{d}{{1,3}}{br}"
            rf"|{bl}[0-9a-fA-F]{{1,4}}:(?:[0-9a-fA-F]{{1,4}}:){{1,6}}[0-9a-fA-F]{{1,4}}{br}"
        ),
        "CREDIT_CARD": rf"{bl}(?:{d}{{4}}{sep}?){{3}}{d}{{4}}{br}",
    }


# A text with none of these strings holds no hit of the label's pattern above.
PII_NEEDS = {"EMAIL": ["@"], "NAME": ["Mr.", "Ms.", "Mrs.", "Dr.", "Prof."]}

# Stop words of the overlap ranking.
STOP_WORDS = (
    "a an and are as at be by can did do does for from how i in is it my of on or our should "
    "the this to was we were what when where which who why with"
).split()

# Words that make a text look like an error report.
ERROR_WORDS = ["error", "exception", "traceback", "failed", "exit code", "err!", "fatal", "undefined", "crash"]

SENSITIVE, UNKNOWN, SAFE = "sensitive", "unknown", "safe"


def is_sensitive(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in secret_patterns().values():
        hit = hit | text.rlike(pattern)
    return hit


def sensitivity(text: Column) -> Column:
    """``sensitive``, ``unknown`` (one long opaque string) or ``safe``; short texts are safe."""
    opaque = (F.length(text) > 32) & text.rlike(r"^[A-Za-z0-9+/=_\-]+\n?$")
    return (
        F.when(text.isNull() | (F.length(text) < 3), SAFE)
        .when(is_sensitive(text), SENSITIVE)
        .when(opaque, UNKNOWN)
        .otherwise(SAFE)
    )


def redact(text: Column) -> Column:
    """Replace secret tokens, then the values of secret-looking assignments."""
    tokens = F.regexp_replace(text, redact_token_pattern(), "[REDACTED]")
    return F.regexp_replace(tokens, redact_assignment_pattern(), "$1[REDACTED]")


def raw_overlap_words(text: Column) -> Column:
    """Words of the overlap ranking with repeats, empty strings and stop words still in.

    A word is alphanumeric runs joined by single ``-``, ``_``, ``.``; a joiner counts only between two
    alphanumerics. Splitting at everything else avoids a repeated regex group, which overflows the
    JVM's stack on very long runs. A separator is a whole run of other characters, unless it is one
    joiner between two alphanumerics; as it starts with one class, most places are passed at once.
    """
    return F.split(F.lower(text), r"[^a-z0-9]++(?<![a-z0-9][-_.](?=[a-z0-9]))")


def overlap_words(text: Column) -> Column:
    """Distinct words of the overlap ranking without stop words."""
    return F.array_except(raw_overlap_words(text), F.array(*[F.lit(w) for w in [""] + STOP_WORDS]))


def index_terms(text: Column) -> Column:
    """Terms of the inverted index: whole words that are plain ASCII letters and digits."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: w.rlike("^[a-z0-9]+$"))


def looks_like_error(text: Column) -> Column:
    """Any error word, or more than five lines."""
    lowered = F.lower(text)
    hit = F.lit(False)
    for word in ERROR_WORDS:
        hit = hit | lowered.contains(word)
    body = F.regexp_replace(text, r"(\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])$", "")
    lines = F.size(F.split(body, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"))
    return hit | (lines > 5)


def one_line(text: Column) -> Column:
    """Collapse runs of white space to single blanks and trim, as joining split words does."""
    return F.trim(F.regexp_replace(text, JVM["ws"] + "+", " "))


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^{JVM['ws']}+|{JVM['ws']}+\z", "")


def content_hash(text: Column) -> Column:
    return F.sha2(strip(text), 256)
