"""Repository URL checks and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewarden.functions.text import trim_unicode

# Accepted URL schemes and known hosts.
SSH_PREFIXES = ("git@", "ssh://")
OTHER_PREFIXES = ("https://", "http://", "git://")
KNOWN_HOSTS = (
    "github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "git.sr.ht", "gitea.com",
    "notabug.org", "framagit.org", "gitlab.gnome.org", "git.kernel.org", "sourcegraph.com",
)


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_repo_url(url: Column) -> Column:
    """Whether the trimmed text is accepted as the URL of a repository to scan."""
    text = trim_unicode(url)
    ssh = _any(text.startswith(p) for p in SSH_PREFIXES)
    scheme = ssh | _any(text.startswith(p) for p in OTHER_PREFIXES)
    known = _any(text.contains(h) for h in KNOWN_HOSTS)
    return scheme & (known | ssh | text.endswith(".git"))


def repo_name_from_url(url: Column) -> Column:
    """Last ``/`` segment without any ``.git``; a trailing slash gives an empty name."""
    return F.replace(F.substring_index(url, "/", -1), F.lit(".git"), F.lit(""))


def report_file_part(name: Column) -> Column:
    """Repository name as part of a file name: every non-alphanumeric becomes ``_``."""
    return F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}]", "_")
