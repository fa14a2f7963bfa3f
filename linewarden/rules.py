"""Line rules.

A rule finds every non-overlapping match of its pattern in a line.  ``anchors`` name cheap
patterns one of which is present in any text the rule matches; together they form the
prefilter that keeps most lines away from the rules.  ``needs`` is a literal present in every
match.  A rule without anchors is its own anchor.

``linear`` is a second form of patterns that would try every start of a run up to its end: where
the first start fails for want of something later in the run, it also matches that rest of the
run, in which no other start can succeed.  Such matches are taken out again by the plain pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column

from linewarden.functions.dialect import PREFIX, java_pattern, sql_literal


@dataclass(frozen=True)
class Rule:
    code: str
    analyzer: str
    rule_id: str
    severity: str
    title: str
    pattern: str
    ci: bool = True
    language: str | None = None
    description: str = ""
    remediation: str | None = None
    title_takes_match: bool = False
    skips_lock_files: bool = False
    anchors: tuple[str, ...] = ()
    needs: str | None = None
    linear: str | None = None

    @property
    def java(self) -> str:
        return java_pattern(self.linear or self.pattern, self.ci)

    @property
    def java_whole(self) -> str:
        """The plain pattern for a whole text; tells matches from what ``linear`` passes over."""
        return java_pattern(rf"\A(?:{self.pattern})\z", self.ci)


# Anchors as (first characters, rest).  The first character is consumed before the rest is
# tried, so a look-behind in the rest sees it.  It should be rare in text: the prefilter stops
# at each.  Letters stand in both cases where a rule ignores case, with the partners of s and k
# outside ASCII in the rest only; a partner as first character is a literal anchor.
_CALLED = (
    r"[xX][eE][cC]|[vV][aA][lL]|[tT][eE][mM]|[pP][eE][nN]|[aA][wW][nN]|[uU][dD][eE]|[iI][rR][eE]"
    r"|[nN][tT][sS\u017f]|[mM][oO][dD]|[aA][lL][lL]|[rR][uU][nN]|[iI][lL][eE]"
    r"|[iI][nN][kK\u212a]|[iI][zZ][eE]|[eE][cC][tT]|[aA][nN][dD]"
)
_ASSIGNED = r"[eE][yY]|[rR][dD]|[wW][dD]|[eE][tT]|[eE][nN]"
ANCHORS: dict[str, tuple[str, str]] = {
    "scheme": (":", "//"),
    "com_slash": (".", "[cC][oO][mM]/"),
    "zeros": (".", r"0\.0\.[01]"),
    "localhost": ("cC", "[aA][lL][hH]"),
    "onion": (".", "onion"),
    "bit": (".", "bit"),
    "local": (".", "local"),
    "dots_slash": (".", r"\.[/\\]"),
    "encoded_dot": ("%", "2[eE]"),
    "tmp": ("/", "[tT][mM][pP]/"),
    "temp_var": ("%", "[tT][eE][mM][pP]%"),
    "temp_dir": ("\\", r"[tT][eE][mM][pP]\\"),
    "call": ("(", rf"(?<=(?:{_CALLED})\s?\(|\s\s\()"),
    "process": ("_", "[pP][rR][oO][cC]"),
    "load": (".", "[lL][oO][aA][dD]"),
    "unpickle": ("kK", "(?<=[nN][pP][iI][cC][kK])"),
    "sevens": ("7", "77"),
    "hex_mode": ("0", "[xX]1[fF]"),
    "php_input": ("$", "_[gGpPrR]"),
    "aws_id": ("A", "KIA|SIA"),
    "google_key": ("A", "Iza"),
    "assign": ("=:", rf"(?<=(?:{_ASSIGNED})[\"']?\s?[:=]|\s\s[:=])\s*+[\"']"),
    "gh_token": ("_", "(?<=gh[pousr]_)"),
    "sk_live": ("_", "(?<=sk_)live_"),
    "jwt": (".", "eyJ"),
    "slack": ("-", "(?<=xox[abprs]-)"),
    "pem": ("-", "----BEGIN"),
}


#: Anchors that are plain text starting with a frequent letter or a character outside Latin-1.
#: A byte search for them is far cheaper than stopping the pattern there.
LITERAL_ANCHORS = {"test": "test", "kelvin": "\u212a"}


def _by_first(names) -> dict[str, list[str]]:
    """Names of pattern anchors by the characters that they start with."""
    found: dict[str, list[str]] = {}
    for name in dict.fromkeys(names):
        for char in ANCHORS[name][0]:
            found.setdefault(char, []).append(name)
    return found


def _class(chars: str) -> str:
    return re.sub(r"[\\\-]", r"\\\g<0>", chars)


def _skipped(by_first: dict[str, list[str]]) -> tuple[str, str]:
    """The first characters, and a loop over a text that stops only before an anchor's.

    It takes everything up to the next first character, and that character too if the rest of
    its anchors does not follow.
    """
    # Characters with the same anchors share a branch; branches are disjoint.
    groups: dict[tuple[str, ...], str] = {}
    for char, names in by_first.items():
        groups[tuple(names)] = groups.get(tuple(names), "") + _class(char)
    starts = "".join(groups.values())
    passed = "|".join(
        f"[{chars}](?!{'|'.join(ANCHORS[n][1] for n in names)})" for names, chars in groups.items()
    )
    return starts, rf"[^{starts}]*(?:(?:{passed})[^{starts}]*)*+"


def _anchor_pattern(names) -> str | None:
    """Java pattern that is found in a text if one of the anchors is.

    It runs over the text once, from its start.  When the loop stops before the end, it stands at
    an anchor.
    """
    by_first = _by_first(names)
    if not by_first:
        return None
    starts, loop = _skipped(by_first)
    return rf"{PREFIX}\A{loop}[{starts}]"


def _look_behind_end(rest: str) -> int:
    """Where the look-behind that begins a rest ends; 0 without one."""
    if not rest.startswith("(?<="):
        return 0
    depth = 0
    for token in re.finditer(r"\\.|\[(?:\\.|[^\]\\])+\]|[()]", rest):
        depth += {"(": 1, ")": -1}.get(token.group(), 0)
        if not depth:
            return token.end()
    raise ValueError(f"open look-behind: {rest}")


def anchor_bits(rules, text: str) -> tuple[dict[str, int], str]:
    """Bits by anchor, and SQL for the set of anchors that occur in a text.

    One pattern walks through the text, each match beginning where the last one ended, and takes
    out every anchor it meets; what differs among them is told apart afterwards.  An anchor whose
    look-behind is all that tells it may be reported where another one with the same first
    character stands: the set is never too small.
    """
    names = list(dict.fromkeys(name for rule in rules for name in rule.anchors))
    bits = {name: 1 << i for i, name in enumerate(names)}
    if len(names) > 62:
        raise ValueError("a set of anchors has 62 at most")
    terms = [
        f"IF(contains({text}, {sql_literal(LITERAL_ANCHORS[n])}), {bits[n]}L, 0L)"
        for n in names if n in LITERAL_ANCHORS
    ]
    by_first = _by_first(n for n in names if n not in LITERAL_ANCHORS)
    if by_first:
        starts, loop = _skipped(by_first)
        # where one is plain and another asks for what stands before, the plain one is taken
        met, known = [], []
        for char, some in by_first.items():
            some = sorted(some, key=lambda n: _look_behind_end(ANCHORS[n][1]) > 0)
            met += [f"[{_class(char)}](?:{ANCHORS[n][1]})" for n in some]
            tests = [
                f"IF(t RLIKE {sql_literal(rf'{PREFIX}\A.(?:{rest})')}, {bits[n]}L, 0L)" if rest else f"{bits[n]}L"
                for n in some for rest in [ANCHORS[n][1][_look_behind_end(ANCHORS[n][1]):]]
            ]
            known.append(f"WHEN {sql_literal(char)} THEN {' | '.join(tests)}")
        pattern = rf"{PREFIX}\G{loop}(?=({'|'.join(met)}))[{starts}]"
        terms.append(
            f"aggregate(array_distinct(regexp_extract_all({text}, {sql_literal(pattern)}, 1)), 0L, "
            f"(met, t) -> met | CASE substring(t, 1, 1) {' '.join(known)} ELSE 0L END)"
        )
    return bits, " | ".join(terms) or "0L"


def prefilter(rules) -> Callable[[Column], Column]:
    """Condition that holds for every text in which any of the rules has a match."""
    literals, patterns = _prefilter(rules)

    def holds(text: Column) -> Column:
        conditions = [text.contains(literal) for literal in literals]
        return reduce(Column.__or__, conditions + [text.rlike(java) for java in patterns])

    return holds


def prefilter_sql(rules, text: str) -> str:
    """The same condition as SQL over the name of a text."""
    literals, patterns = _prefilter(rules)
    return " OR ".join(
        [f"contains({text}, {sql_literal(literal)})" for literal in literals]
        + [f"{text} RLIKE {sql_literal(java)}" for java in patterns]
    )


def _prefilter(rules) -> tuple[list[str], list[str]]:
    """Literals and patterns one of which is in every text that a rule matches."""
    names = [name for rule in rules for name in rule.anchors]
    literals = dict.fromkeys(LITERAL_ANCHORS[n] for n in names if n in LITERAL_ANCHORS)
    pattern = _anchor_pattern(n for n in names if n not in LITERAL_ANCHORS)
    own = dict.fromkeys(rule.java for rule in rules if not rule.anchors)
    return list(literals), [pattern] * bool(pattern) + list(own)


def _url(code, severity, title, pattern, *anchors, needs=None, linear=None):
    return Rule(
        code, "url", "URL-HARDCODED", severity, title, pattern,
        remediation=_MOVE_URLS, skips_lock_files=True, anchors=anchors, needs=needs, linear=linear,
    )


def _credentials(scheme: str, user: str, host: str) -> str:
    """``scheme://user:password@host``; a run without any further ``@`` is passed over."""
    return rf"{scheme}://{user}:(?:[^\s@]+@{host}|[^\s@]++(?=\s|$))"


def _domain(code, severity, literal, anchor):
    return Rule(
        code, "url", "URL-SUSPICIOUS-DOMAIN", severity, "Suspicious domain detected: ",
        literal.replace(".", r"\."), ci=False, title_takes_match=True, skips_lock_files=True,
        anchors=(anchor,), needs=literal,
    )


def _file(number, severity, title, pattern, *anchors, needs=None, linear=None):
    return Rule(
        f"F{number:02d}", "file-ops", f"FILE-{number:03d}", severity, title, pattern,
        anchors=anchors, needs=needs, linear=linear,
    )


def _lang(code, severity, language, title, pattern, *anchors, needs=None, linear=None):
    return Rule(
        code, "file-ops", "FILE-LANG-001", severity, title, pattern,
        language=language, anchors=anchors, needs=needs, linear=linear,
    )


def _secret(code, rule_id, severity, thing, pattern, *anchors, ci=False, needs=None, linear=None):
    return Rule(
        code, "secrets", rule_id, severity, f"{thing} detected", pattern, ci=ci,
        description=f"{thing} detected", remediation=_REMOVE_SECRETS,
        anchors=anchors, needs=needs, linear=linear,
    )


# The patterns, titles, severities and remediation texts below define the results.
_MOVE_URLS = "Move sensitive URLs to environment variables or configuration files"
_REMOVE_SECRETS = "Remove credentials from code and use environment variables"
URL_RULES = (
    _url("U01", "HIGH", "Hardcoded S3 URL with potential access key",
         r"\b(https?://[a-z0-9\-]+\.s3\.amazonaws\.com/[^\s]+[A-Za-z0-9/=_\-]{20,})",
         "scheme", needs="://",
         linear=r"\b(https?://[a-z0-9\-]+\.s3\.amazonaws\.com/(?:[^\s]+[A-Za-z0-9/=_\-]{20,}|[^\s]*+))"),
    _url("U02", "LOW", "Hardcoded S3 endpoint",
         r"\b(https?://[a-z0-9\-]+\.s3\.amazonaws\.com)", "scheme", needs="://"),
    _url("U03", "CRITICAL", "Hardcoded MongoDB connection string",
         r"(mongodb\+srv://[^\s:]+:[^\s@]+@[^\s/]+)", "scheme", needs="@",
         linear=_credentials(r"mongodb\+srv", r"[^\s:]+", r"[^\s/]+")),
    _url("U04", "CRITICAL", "Hardcoded Redis connection string",
         r"(redis://[^\s:]+:[^\s@]+@[^\s/]+)", "scheme", needs="@",
         linear=_credentials(r"redis", r"[^\s:]+", r"[^\s/]+")),
    _url("U05", "CRITICAL", "Hardcoded PostgreSQL connection string",
         r"(postgresql://[^\s:]+:[^\s@]+@[^\s/]+)", "scheme", needs="@",
         linear=_credentials(r"postgresql", r"[^\s:]+", r"[^\s/]+")),
    _url("U06", "CRITICAL", "Hardcoded PostgreSQL connection string",
         r"(postgres://[^\s:]+:[^\s@]+@[^\s/]+)", "scheme", needs="@",
         linear=_credentials(r"postgres", r"[^\s:]+", r"[^\s/]+")),
    _url("U07", "CRITICAL", "Hardcoded MySQL connection string",
         r"(mysql://[^\s:]+:[^\s@]+@[^\s/]+)", "scheme", needs="@",
         linear=_credentials(r"mysql", r"[^\s:]+", r"[^\s/]+")),
    _url("U08", "MEDIUM", "Potential hardcoded API endpoint",
         r'\b(https?://(api\.|www\.)?[a-z0-9\-]+\.com/[^\s"]{20,})', "scheme", needs="://"),
    _url("U09", "MEDIUM", "Direct IP address URL",
         r"\b(https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})[:/]",
         "scheme", needs="://"),
    _url("U10", "HIGH", "Possible leaked content on paste site",
         r"\b(pastebin\.com|gist\.github\.com)/[a-z0-9]+", "com_slash", needs="."),
    _url("U11", "INFO", "Local development endpoint (may indicate dev config in prod)",
         r"\b(127\.0\.0\.1|localhost|0\.0\.0\.0)(:[0-9]+)?", "zeros", "localhost"),
    _url("U12", "MEDIUM", "FTP URL (insecure protocol)",
         r'\bftp://[^\s"]+', "scheme", needs="://"),
    _url("U13", "HIGH", "HTTP (not HTTPS) URL for AWS",
         r'\bhttp://[^\s"]+\.amazonaws\.com', "scheme", needs="://",
         linear=r'\bhttp://(?:[^\s"]+\.amazonaws\.com|[^\s"]*+)'),
)
DOMAIN_RULES = (
    _domain("D01", "HIGH", ".onion", "onion"),
    _domain("D02", "MEDIUM", ".bit", "bit"),
    _domain("D03", "INFO", ".local", "local"),
    _domain("D04", "INFO", "test", "test"),
)
FILE_RULES = (
    _file(1, "MEDIUM", "Path traversal pattern detected (../)", r"\.\.\/",
          "dots_slash", needs="../"),
    _file(2, "MEDIUM", "URL-encoded path traversal pattern", r"%2e%2e",
          "encoded_dot", needs="%"),
    _file(3, "MEDIUM", "Windows path traversal pattern detected (..\\)", r"\.\.\\",
          "dots_slash", needs="..\\"),
    _file(4, "LOW", "Usage of /tmp directory (may have security implications)", r"/tmp/",
          "tmp", needs="/"),
    _file(5, "LOW", "Usage of Windows temp directory", r"%TEMP%|\\Temp\\",
          "temp_var", "temp_dir"),
    _file(6, "HIGH", "Use of eval/exec functions (code injection risk)",
          r"\.exec\(|\.eval\(|eval\s*\(", "call", needs="("),
    _file(7, "HIGH", "Use of system/shell execution functions",
          r"exec\s*\(|system\s*\(|popen\s*\(", "call", needs="("),
    _file(8, "MEDIUM", "Use of child process spawning (command injection risk)",
          r"spawn\s*\(|child_process", "call", "process"),
    _file(9, "MEDIUM", "Dynamic file inclusion (may lead to remote file inclusion)",
          r"include\s*\(|require\s*\(", "call", needs="("),
    _file(10, "MEDIUM", "Use of file_get_contents/put_contents (may be unsafe with user input)",
          r"file_get_contents\s*\(|file_put_contents\s*\(", "call", needs="("),
    _file(11, "HIGH", "Use of pickle deserialization (can execute arbitrary code)",
          r"pickle\.load|unpickle", "load", "unpickle", "kelvin"),
    _file(12, "HIGH", "Unsafe YAML loading (may execute arbitrary code)",
          r"yaml\.load\(.*\)", "load", needs="(", linear=r"yaml\.load\((?:.*\)|.*+)"),
    _file(13, "MEDIUM", "World-writable file permissions (777)", r"0777|0x1ff|777",
          "sevens", "hex_mode"),
    _file(14, "MEDIUM", "chmod with 777 permissions (world-writable)",
          r"chmod\s*\([^)]*0777", "sevens", needs="0777",
          linear=r"chmod\s*\((?:[^)]*0777|[^)]*+)"),
)
# L03 and L04 are written without adjacent repeats over the same characters, which match the same
# spans.
LANGUAGE_RULES = (
    _lang("L01", "HIGH", "python", "Dynamic file path construction (path traversal risk)",
          r"""open\s*\(\s*['\"]\w+\s*\+\s*""", "call", needs="("),
    _lang("L02", "HIGH", "python", "Subprocess with shell=True (command injection risk)",
          r"subprocess\.(call|run|Popen)\s*\(\s*shell\s*=\s*True", "call", needs="("),
    _lang("L03", "HIGH", "javascript", "Dynamic file path construction in fs operations",
          r"fs\.(readFile|writeFile|unlink)\s*\([^,]*\+", "call", needs="+",
          linear=r"fs\.(readFile|writeFile|unlink)\s*\((?:[^,]*\+|[^,]*+)"),
    _lang("L04", "HIGH", "javascript", "Dynamic require() (code injection risk)",
          r"require\s*\([^)]*\+", "call", needs="+",
          linear=r"require\s*\((?:[^)]*\+|[^)]*+)"),
    _lang("L05", "MEDIUM", "javascript", "Use of child_process (command injection risk)",
          r"child_process\.(exec|spawn)\s*\(", "call", needs="("),
    _lang("L06", "HIGH", "php", "Direct use of user input in file operations",
          r"\$_(GET|POST|REQUEST)\[[^\]]+\]\s*\)\s*\);", "php_input", needs="$_",
          linear=r"\$_(GET|POST|REQUEST)\[(?:[^\]]+\]\s*\)\s*\);|[^\]]*+)"),
    _lang("L07", "HIGH", "php", "Use of unserialize (object injection risk)",
          r"unserialize\s*\(", "call", needs="("),
    _lang("L08", "HIGH", "java", "Use of Runtime.exec() (command injection risk)",
          r"Runtime\.getRuntime\(\)\.exec\s*\(", "call", needs="("),
    _lang("L09", "MEDIUM", "java", "Use of ObjectInputStream (deserialization risk)",
          r"ObjectInputStream\.readObject\s*\(", "call", needs="("),
    _lang("L10", "HIGH", "go", "Dynamic command construction (command injection risk)",
          r"exec\.Command\s*\([^,]*\+", "call", needs="+",
          linear=r"exec\.Command\s*\((?:[^,]*\+|[^,]*+)"),
)
SECRET_RULES = (
    _secret("S01", "AWS-001", "CRITICAL", "AWS Access Key",
            r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "aws_id"),
    _secret("S02", "AWS-002", "CRITICAL", "AWS Secret Access Key",
            r"""(?:aws_?)?secret_?access_?key["']?\s*[:=]\s*["'][A-Za-z0-9/+=]{40}["']""",
            "assign", ci=True),
    _secret("S03", "GITHUB-001", "CRITICAL", "GitHub token",
            r"\bgh[pousr]_[A-Za-z0-9]{36,}", "gh_token", needs="_"),
    _secret("S04", "DB-001", "CRITICAL", "Database connection string",
            r"""\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/]*:[^\s@]+@[^\s/"']+""",
            "scheme", ci=True, needs="@", linear=_credentials(
                r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)", r"[^\s:@/]*", r"""[^\s/"']+"""
            )),
    _secret("S05", "STRIPE-001", "CRITICAL", "Stripe API key",
            r"\bsk_(?:live|test)_[A-Za-z0-9_]{16,}", "test", "sk_live", needs="sk_"),
    _secret("S06", "JWT-001", "HIGH", "JSON Web Token",
            r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "jwt", needs=".eyJ",
            linear=r"\beyJ(?:[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+|[A-Za-z0-9_-]*+)"),
    _secret("S07", "SLACK-001", "HIGH", "Slack token",
            r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "slack", needs="xox"),
    _secret("S08", "GOOGLE-001", "HIGH", "Google API key",
            r"\bAIza[0-9A-Za-z_-]{30,}", "google_key", needs="AIza"),
    _secret("S09", "KEY-001", "CRITICAL", "Private key",
            r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z]+ )*+PRIVATE KEY-----", "pem", needs="-----BEGIN "),
    _secret("S10", "PASSWORD-001", "HIGH", "Hardcoded password",
            r"""\b(?:password|passwd|pwd)\s*[:=]\s*["'][^"'\s]{8,}["']""", "assign", ci=True),
    _secret("S11", "APIKEY-001", "HIGH", "API key",
            r"""\b(?:api_?key|secret|token)\s*[:=]\s*["'][A-Za-z0-9_-]{16,}["']""",
            "assign", ci=True),
)

ALL_RULES = URL_RULES + DOMAIN_RULES + SECRET_RULES + FILE_RULES + LANGUAGE_RULES
