"""Hard-coded secrets in added lines.

The rules are our own; what they must do is that provider formats are found
with high confidence whatever their surroundings, generic assignments and
random-looking strings with less, placeholders and references to the
environment not at all, and that no raw value leaves the scanner.

What a finding shows of a line is masked before any other use: the places of
all values that any rule could name are found on the line as it is, united,
and replaced together, so that no replacement hides a value from the next
rule. A mask takes the whole value, not the part that a rule needs to tell it:

* a quoted value up to its closing quote, that is, the first one that something
  follows which ends a value (a comma, a bracket, an operator, the line's end);
  without one, all of the rest of the line;
* the password of a connection string up to the last ``@`` of that value;
* all that an environment file assigns, blanks and ``#`` included;
* all of a line after the beginning of a private key.

A mask may so take more than the value; what it shows is never part of one.
"""

from __future__ import annotations

from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftscan.functions.spans import NONE, group_spans, let, replaced, united
from riftscan.functions.text import shannon_entropy, trim_all, truncate
from riftscan.operators.rules import exploded, finding_fields

DATABASE = r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|mssql)://[^:/\s\"'`@]*:"
#: What follows a quote that closes a value.
CLOSES = r"\s*+(?:[;,)\]}:+|&?/#=<>.-]|\z)"


def inside(quote: str) -> str:
    """What a quoted value holds, up to the quote that closes it or the line's end."""
    return rf"(?:\\.|(?!{quote}{CLOSES}).)*+"


#: name, pattern (group 1 is shown, group 2 is masked), confidence, level.
PROVIDERS = (
    ("AWS Access Key ID", r"()(AKIA[0-9A-Z]{16})", "high", "critical"),
    ("AWS Secret Access Key", r"((?i:aws)[A-Za-z_]*(?i:secret)[A-Za-z_]*[\"'`]?\s*[:=]\s*[\"'`]?)([A-Za-z0-9/+=]{40})(?![A-Za-z0-9/+=])", "high", "critical"),
    ("Private Key", r"()(-----BEGIN [A-Z ]*PRIVATE KEY-----)", "high", "critical"),
    ("GitHub Token", r"()(gh[pousr]_[A-Za-z0-9]{36,})", "high", "critical"),
    ("Database Connection String", r"(" + DATABASE + r")([^\s\"'`]+)@", "high", "critical"),
    ("Slack Token", r"()(xox[baprs]-[0-9A-Za-z-]{10,})", "high", "critical"),
    ("JSON Web Token", r"()(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", "high", "critical"),
)
ENV_NAME = r"\A\s*(?:export\s+)?[A-Z][A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|KEY)[A-Z0-9_]*\s*=\s*"
ENV_FILE = ENV_NAME + r"(?:\"[^\"]{8,}|'[^']{8,}|[^\s\"'#]{8,})"
NAMES = "api_?key|apikey|secret|token|passw(?:or)?d|auth|credential"
GENERIC = rf"((?i:{NAMES})[A-Za-z0-9_]*\s*[:=]\s*[\"'`])([A-Za-z0-9+/=_.-]{{16,}})[\"'`]"
LOOSE = r"([\"'`])([A-Za-z0-9+/=_-]{20,})[\"'`]"
#: Marks of a key's kind, which a mask leaves.
MARK = "(?:(?:sk|pk|rk)-)?"
#: Patterns whose second group is masked.
VALUES = (
    r"()(AKIA[0-9A-Z]{16,}+)",
    r"()(-----BEGIN [A-Z ]*PRIVATE KEY-----.*+)",
    r"()(gh[pousr]_[A-Za-z0-9]{36,}+)",
    r"()(xox[baprs]-[0-9A-Za-z-]{10,}+)",
    r"()(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_.-]{8,}+)",
    r"(\b(?:sk|pk|rk)-)([A-Za-z0-9_-]{8,}+)",
    rf"({ENV_NAME}[\"'`]?)(.+?)(?=[\"'`]?\s*\z)",
    *[rf"((?i:{NAMES}|key|pwd|passphrase)[A-Za-z0-9_-]{{0,64}}+[\"'`]?\s*+[:=]\s*+{q}{MARK})({inside(q)})" for q in ("\"", "'", "`")],
    rf"((?i:{NAMES}|key|pwd|passphrase)[A-Za-z0-9_-]{{0,64}}+\s*+[:=]\s*+)(?=[^\s\"'`();,]*[0-9])([^\s\"'`();,{{}}\[\]]{{16,}}+)",
    *[rf"({q}{MARK})(?=[A-Za-z0-9+/=_-]{{20}})({inside(q)})" for q in ("\"", "'", "`")],
)
#: Connection strings in quotes, and any; of group 2 what stands before the last @ is the password.
QUOTED_DATABASE = tuple(rf"({q}{DATABASE})(?![0-9]+(?:[/?]|{q}|\z))({inside(q)})" for q in ("\"", "'", "`"))
ANY_DATABASE = rf"({DATABASE})(.*+)"
PLACEHOLDER = r"(?i)your[-_]|change[-_ ]?me|example|placeholder|dummy|sample|xxxx|<[^>]+>|todo|replace"
ENVIRONMENT = r"process\.env|os\.environ|getenv|\$\{|\$\("
#: A quoted name of an environment variable: no value.
ENVIRONMENT_NAME = r"(?:process\.env|os\.environ|getenv)(?:\.get)?\s*[\[(]\s*(?:\"[^\"]*\"|'[^']*')"
#: The whole value that an environment file assigns.
ENV_VALUE = r"\A[^=]*=\s*(\"[^\"]*\"|'[^']*'|[^#]*)"
GENERIC_ENTROPY, LOOSE_ENTROPY = 3.5, 4.0
MASK = "***REDACTED***"


#: Length of what stands before a value's last @; 0 if there is none.
BEFORE_AT = "CASE WHEN contains(v, '@') THEN char_length(v) - char_length(substring_index(v, '@', -1)) - 1 ELSE 0 END"


@cache
def masked_sql(column: str) -> str:
    spans = ", ".join(group_spans(column, "(?s)" + p) for p in VALUES)
    databases = ", ".join(group_spans(column, "(?s)" + p, BEFORE_AT) for p in (*QUOTED_DATABASE, ANY_DATABASE))
    every = f"concat({spans}, CASE WHEN contains({column}, '://') THEN concat({databases}) ELSE {NONE} END)"
    return let(united(every), "found", replaced(column, "found", MASK))


def masked(column: str = "content") -> Column:
    """The line with every value that any rule could name masked."""
    return F.expr(masked_sql(column))


def benign(value: Column) -> Column:
    """Whether a value is a placeholder or taken from the environment."""
    return value.rlike(PLACEHOLDER) | value.rlike(ENVIRONMENT)


def real_password(pattern: str) -> Column:
    """Whether a connection string of the line holds a password itself."""
    real = lambda v: ~v.rlike(ENVIRONMENT)
    held = F.exists(F.regexp_extract_all("content", F.lit(pattern), F.lit(2)), real)
    for p in QUOTED_DATABASE:  # in quotes a password may hold blanks and other quotes
        values = F.regexp_extract_all("content", F.lit("(?s)" + p), F.lit(2))
        held = held | F.exists(values, lambda v: F.contains(v, F.lit("@")) & ~F.startswith(v, F.lit("@")) & real(v))
    return F.contains(F.col("content"), F.lit("://")) & held


#: What the line may hold for any rule to match, as texts (the first ones in lower case) or by a pattern: everything else is left out by one look.
ANY_NAME = ("secret", "token", "passw", "key", "auth", "credential")
ANY_TEXT = ("AKIA", "PRIVATE KEY", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "://", "xox", "eyJ")
ANY_VALUE = r"[\"'`][A-Za-z0-9+/=_-]{20}"
HARDCODED = "hardcoded_secret"
RULES = [(HARDCODED, "the line holds a value in this provider's format", name, confidence, level) for name, _, confidence, level in PROVIDERS] + [
    (HARDCODED, "an environment file assigns a secret", ".env Secret", "high", "critical"),
    (HARDCODED, "a name for a secret is assigned a random-looking value", "Generic API Key or Token", "medium", "high"),
    (HARDCODED, "a quoted value looks random", "High-Entropy String", "low", "medium"),
]


def scan_secrets(lines: DataFrame) -> DataFrame:
    """file, line and the finding's fields; of generic and loose matches only the stronger one is kept.

    A placeholder or a reference to the environment rules out the value that is
    one, not the line that mentions one; of several values on a line any may
    count. Conditions are made in stages, so that each pattern runs once for a
    line; the masked line is made for lines with a finding only.
    """
    content, n = F.col("content"), len(PROVIDERS)
    held = [real_password(p) if name.startswith("Database") else content.rlike(p) for name, p, _, _ in PROVIDERS]
    # The filter stands above a generator, as in ``exploded``: each line is made once, not anew for every text that is looked for.
    looks = [*[F.contains(F.col("low"), F.lit(w)) for w in ANY_NAME], *[F.contains(content, F.lit(w)) for w in ANY_TEXT], content.rlike(ANY_VALUE)]
    made = lines.select("file", "line", "content", F.lower(content).alias("low"))
    may = made.select("file", "line", F.explode_outer(F.when(reduce(or_, looks), F.array(content))).alias("content")).where("content is not null")
    every = lambda p: F.regexp_extract_all(F.regexp_replace("content", ENVIRONMENT_NAME, ""), F.lit(p), F.lit(2))
    flags = may.select("file", "line", "content", *[h.alias(f"p{k}") for k, h in enumerate(held)], every(GENERIC).alias("generic"), every(LOOSE).alias("loose"))
    provider = F.greatest(*[F.col(f"p{k}") for k in range(n)])
    in_env = F.col("file").rlike(r"(?:\A|/)\.env[^/]*\z") & content.rlike(ENV_FILE) & ~benign(F.regexp_extract("content", ENV_VALUE, 1))
    other = flags.withColumn("open", ~provider)
    other = other.withColumn("in_env", F.col("open") & in_env)
    other = other.withColumn("is_generic", F.col("open") & ~F.col("in_env") & F.exists("generic", lambda v: ~benign(v) & (shannon_entropy(v) >= GENERIC_ENTROPY)))
    is_loose = F.col("open") & ~F.col("in_env") & ~F.col("is_generic") & F.exists("loose", lambda v: ~benign(v) & (shannon_entropy(v) > LOOSE_ENTROPY))
    numbers = F.array(*[F.when(F.col(f"p{k}"), F.lit(k)) for k in range(n)], F.when(F.col("in_env"), F.lit(n)), F.when(F.col("is_generic"), F.lit(n + 1)), F.when(is_loose, F.lit(n + 2)))
    found = exploded(other.select("file", "line", "content", numbers.alias("numbers")))
    return found.select("file", "line", "rule_pos", truncate(trim_all(masked())).alias("snippet")).select("file", "line", *finding_fields("secret_scanner", RULES))
