"""What the SQL of the registered queries expects, written out once more.

Nothing here is imported from the code that the SQL checks, so a change of a rule, a list or an
advisory in one of the two places turns a query red.
"""

from __future__ import annotations

from typing import NamedTuple


class Expected(NamedTuple):
    """A line rule as the SQL runs it; patterns are in the plain form."""

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


# The rules of the built-in analyzers, in their order.
RULES = (
    Expected(
        "U01", "url", "URL-HARDCODED", "HIGH", "Hardcoded S3 URL with potential access key",
        r"\b(https?://[a-z0-9\-]+\.s3\.amazonaws\.com/[^\s]+[A-Za-z0-9/=_\-]{20,})",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U02", "url", "URL-HARDCODED", "LOW", "Hardcoded S3 endpoint",
        r"\b(https?://[a-z0-9\-]+\.s3\.amazonaws\.com)",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U03", "url", "URL-HARDCODED", "CRITICAL", "Hardcoded MongoDB connection string",
        r"(mongodb\+srv://[^\s:]+:[^\s@]+@[^\s/]+)",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U04", "url", "URL-HARDCODED", "CRITICAL", "Hardcoded Redis connection string",
        r"(redis://[^\s:]+:[^\s@]+@[^\s/]+)",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U05", "url", "URL-HARDCODED", "CRITICAL", "Hardcoded PostgreSQL connection string",
        r"(postgresql://[^\s:]+:[^\s@]+@[^\s/]+)",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U06", "url", "URL-HARDCODED", "CRITICAL", "Hardcoded PostgreSQL connection string",
        r"(postgres://[^\s:]+:[^\s@]+@[^\s/]+)",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U07", "url", "URL-HARDCODED", "CRITICAL", "Hardcoded MySQL connection string",
        r"(mysql://[^\s:]+:[^\s@]+@[^\s/]+)",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U08", "url", "URL-HARDCODED", "MEDIUM", "Potential hardcoded API endpoint",
        r"""\b(https?://(api\.|www\.)?[a-z0-9\-]+\.com/[^\s"]{20,})""",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U09", "url", "URL-HARDCODED", "MEDIUM", "Direct IP address URL",
        r"\b(https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})[:/]",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U10", "url", "URL-HARDCODED", "HIGH", "Possible leaked content on paste site",
        r"\b(pastebin\.com|gist\.github\.com)/[a-z0-9]+",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U11", "url", "URL-HARDCODED", "INFO",
        "Local development endpoint (may indicate dev config in prod)",
        r"\b(127\.0\.0\.1|localhost|0\.0\.0\.0)(:[0-9]+)?",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U12", "url", "URL-HARDCODED", "MEDIUM", "FTP URL (insecure protocol)", r"""\bftp://[^\s"]+""",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "U13", "url", "URL-HARDCODED", "HIGH", "HTTP (not HTTPS) URL for AWS",
        r"""\bhttp://[^\s"]+\.amazonaws\.com""",
        remediation="Move sensitive URLs to environment variables or configuration files",
        skips_lock_files=True,
    ),
    Expected(
        "D01", "url", "URL-SUSPICIOUS-DOMAIN", "HIGH", "Suspicious domain detected: ", r"\.onion",
        ci=False, title_takes_match=True, skips_lock_files=True,
    ),
    Expected(
        "D02", "url", "URL-SUSPICIOUS-DOMAIN", "MEDIUM", "Suspicious domain detected: ", r"\.bit",
        ci=False, title_takes_match=True, skips_lock_files=True,
    ),
    Expected(
        "D03", "url", "URL-SUSPICIOUS-DOMAIN", "INFO", "Suspicious domain detected: ", r"\.local",
        ci=False, title_takes_match=True, skips_lock_files=True,
    ),
    Expected(
        "D04", "url", "URL-SUSPICIOUS-DOMAIN", "INFO", "Suspicious domain detected: ", "test",
        ci=False, title_takes_match=True, skips_lock_files=True,
    ),
    Expected(
        "S01", "secrets", "AWS-001", "CRITICAL", "AWS Access Key detected",
        r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ci=False, description="AWS Access Key detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "S02", "secrets", "AWS-002", "CRITICAL", "AWS Secret Access Key detected",
        r"""(?:aws_?)?secret_?access_?key["']?\s*[:=]\s*["'][A-Za-z0-9/+=]{40}["']""",
        description="AWS Secret Access Key detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "S03", "secrets", "GITHUB-001", "CRITICAL", "GitHub token detected",
        r"\bgh[pousr]_[A-Za-z0-9]{36,}", ci=False, description="GitHub token detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "S04", "secrets", "DB-001", "CRITICAL", "Database connection string detected",
        r"""\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/]*:[^\s@]+@[^\s/"']+""",
        description="Database connection string detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "S05", "secrets", "STRIPE-001", "CRITICAL", "Stripe API key detected",
        r"\bsk_(?:live|test)_[A-Za-z0-9_]{16,}", ci=False, description="Stripe API key detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "S06", "secrets", "JWT-001", "HIGH", "JSON Web Token detected",
        r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", ci=False,
        description="JSON Web Token detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "S07", "secrets", "SLACK-001", "HIGH", "Slack token detected",
        r"\bxox[abprs]-[A-Za-z0-9-]{10,}", ci=False, description="Slack token detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "S08", "secrets", "GOOGLE-001", "HIGH", "Google API key detected", r"\bAIza[0-9A-Za-z_-]{30,}",
        ci=False, description="Google API key detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "S09", "secrets", "KEY-001", "CRITICAL", "Private key detected",
        "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ci=False, description="Private key detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "S10", "secrets", "PASSWORD-001", "HIGH", "Hardcoded password detected",
        r"""\b(?:password|passwd|pwd)\s*[:=]\s*["'][^"'\s]{8,}["']""",
        description="Hardcoded password detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "S11", "secrets", "APIKEY-001", "HIGH", "API key detected",
        r"""\b(?:api_?key|secret|token)\s*[:=]\s*["'][A-Za-z0-9_-]{16,}["']""",
        description="API key detected",
        remediation="Remove credentials from code and use environment variables",
    ),
    Expected(
        "F01", "file-ops", "FILE-001", "MEDIUM", "Path traversal pattern detected (../)", r"\.\.\/",
    ),
    Expected(
        "F02", "file-ops", "FILE-002", "MEDIUM", "URL-encoded path traversal pattern", "%2e%2e",
    ),
    Expected(
        "F03", "file-ops", "FILE-003", "MEDIUM", r"Windows path traversal pattern detected (..\)",
        r"\.\.\\",
    ),
    Expected(
        "F04", "file-ops", "FILE-004", "LOW",
        "Usage of /tmp directory (may have security implications)", "/tmp/",
    ),
    Expected(
        "F05", "file-ops", "FILE-005", "LOW", "Usage of Windows temp directory", r"%TEMP%|\\Temp\\",
    ),
    Expected(
        "F06", "file-ops", "FILE-006", "HIGH", "Use of eval/exec functions (code injection risk)",
        r"\.exec\(|\.eval\(|eval\s*\(",
    ),
    Expected(
        "F07", "file-ops", "FILE-007", "HIGH", "Use of system/shell execution functions",
        r"exec\s*\(|system\s*\(|popen\s*\(",
    ),
    Expected(
        "F08", "file-ops", "FILE-008", "MEDIUM",
        "Use of child process spawning (command injection risk)", r"spawn\s*\(|child_process",
    ),
    Expected(
        "F09", "file-ops", "FILE-009", "MEDIUM",
        "Dynamic file inclusion (may lead to remote file inclusion)", r"include\s*\(|require\s*\(",
    ),
    Expected(
        "F10", "file-ops", "FILE-010", "MEDIUM",
        "Use of file_get_contents/put_contents (may be unsafe with user input)",
        r"file_get_contents\s*\(|file_put_contents\s*\(",
    ),
    Expected(
        "F11", "file-ops", "FILE-011", "HIGH",
        "Use of pickle deserialization (can execute arbitrary code)", r"pickle\.load|unpickle",
    ),
    Expected(
        "F12", "file-ops", "FILE-012", "HIGH", "Unsafe YAML loading (may execute arbitrary code)",
        r"yaml\.load\(.*\)",
    ),
    Expected(
        "F13", "file-ops", "FILE-013", "MEDIUM", "World-writable file permissions (777)",
        "0777|0x1ff|777",
    ),
    Expected(
        "F14", "file-ops", "FILE-014", "MEDIUM", "chmod with 777 permissions (world-writable)",
        r"chmod\s*\([^)]*0777",
    ),
    Expected(
        "L01", "file-ops", "FILE-LANG-001", "HIGH",
        "Dynamic file path construction (path traversal risk)", r"""open\s*\(\s*['\"]\w+\s*\+\s*""",
        language="python",
    ),
    Expected(
        "L02", "file-ops", "FILE-LANG-001", "HIGH",
        "Subprocess with shell=True (command injection risk)",
        r"subprocess\.(call|run|Popen)\s*\(\s*shell\s*=\s*True", language="python",
    ),
    Expected(
        "L03", "file-ops", "FILE-LANG-001", "HIGH", "Dynamic file path construction in fs operations",
        r"fs\.(readFile|writeFile|unlink)\s*\([^,]*\+", language="javascript",
    ),
    Expected(
        "L04", "file-ops", "FILE-LANG-001", "HIGH", "Dynamic require() (code injection risk)",
        r"require\s*\([^)]*\+", language="javascript",
    ),
    Expected(
        "L05", "file-ops", "FILE-LANG-001", "MEDIUM", "Use of child_process (command injection risk)",
        r"child_process\.(exec|spawn)\s*\(", language="javascript",
    ),
    Expected(
        "L06", "file-ops", "FILE-LANG-001", "HIGH", "Direct use of user input in file operations",
        r"\$_(GET|POST|REQUEST)\[[^\]]+\]\s*\)\s*\);", language="php",
    ),
    Expected(
        "L07", "file-ops", "FILE-LANG-001", "HIGH", "Use of unserialize (object injection risk)",
        r"unserialize\s*\(", language="php",
    ),
    Expected(
        "L08", "file-ops", "FILE-LANG-001", "HIGH", "Use of Runtime.exec() (command injection risk)",
        r"Runtime\.getRuntime\(\)\.exec\s*\(", language="java",
    ),
    Expected(
        "L09", "file-ops", "FILE-LANG-001", "MEDIUM",
        "Use of ObjectInputStream (deserialization risk)", r"ObjectInputStream\.readObject\s*\(",
        language="java",
    ),
    Expected(
        "L10", "file-ops", "FILE-LANG-001", "HIGH",
        "Dynamic command construction (command injection risk)", r"exec\.Command\s*\([^,]*\+",
        language="go",
    ),
)
#: Built-in analyzers by place.
ANALYZERS = ("url", "secrets", "file-ops", "dependencies")

# Extensions that a listing leaves out.
LISTING_BINARY_EXTENSIONS = (
    "exe", "dll", "so", "dylib", "bin", "png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "tar",
    "gz", "7z", "woff", "woff2",
)
# Binary extensions.
BINARY_EXTENSIONS = (
    "exe", "dll", "so", "dylib", "bin", "png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "tar",
    "gz", "7z", "rar", "bz2", "xz", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "avi", "mov",
    "wmv", "flv", "mkv", "class", "jar", "war", "ear", "a", "lib", "obj", "o",
)
# Text extensions.
TEXT_EXTENSIONS = (
    "txt", "md", "rst", "adoc", "json", "yaml", "yml", "toml", "xml", "html", "htm", "css",
    "scss", "sass", "less", "js", "jsx", "ts", "tsx", "py", "rs", "go", "java", "kt", "kts", "c",
    "h", "cpp", "hpp", "cc", "cxx", "cs", "php", "rb", "sh", "bash", "zsh", "fish", "ps1", "psm1",
    "sql", "graphql", "gql", "wsdl", "xsd", "dtd", "xslt", "svg", "vue", "svelte", "astro", "elm",
    "dart", "lua", "r", "rmd", "jl", "nim", "v", "zig", "cr", "ex", "exs", "erl", "hs", "lhs",
    "fs", "fsi", "fsx", "ml", "mli", "lisp", "lsp", "scm", "rkt", "clj", "cljs", "cljc", "edn",
    "pl", "pm", "t", "pod",
)
# Folders that a listing leaves out.
LISTING_IGNORED_DIRS = (
    ".git", "node_modules", "target", ".venv", "venv", "__pycache__", ".vscode", ".idea", "dist",
    "build",
)
# Ignored folders.
IGNORED_DIRS = (
    ".git", ".svn", ".hg", "node_modules", "target", "build", "dist", ".venv", "venv",
    ".virtualenv", "__pycache__", ".pytest_cache", ".vscode", ".idea", ".vs", "vendor",
    "third_party", ".bundle", "tmp", "temp", ".gradle", "gradle", ".maven", "maven",
)
# Lock files.
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "go.sum", "pom.xml",
    "build.gradle", "gradle.lock", "gemfile.lock", "composer.lock", "packages.lock.json",
    "poetry.lock",
)
# Names below which no URL is looked for.
URL_SKIPPED_NAMES = (
    "package-lock.json", "yarn.lock", "Cargo.lock",
)
# Languages by extension.
LANGUAGES = {
    "py": "python",
    "pyw": "python",
    "js": "javascript",
    "ts": "javascript",
    "jsx": "javascript",
    "tsx": "javascript",
    "php": "php",
    "java": "java",
    "jar": "java",
    "go": "go",
    "rs": "rust",
    "rb": "ruby",
    "cs": "csharp",
}
# Suspicious suffixes.
SUSPICIOUS_EXTENSIONS = (
    (".bak", "Backup file (may contain sensitive data)", "LOW"),
    (".backup", "Backup file (may contain sensitive data)", "LOW"),
    (".old", "Old version of file", "INFO"),
    (".tmp", "Temporary file", "INFO"),
    (".swp", "Vim swap file (may contain unsaved changes)", "LOW"),
    (".swo", "Vim swap file", "LOW"),
    (".~", "Backup file", "INFO"),
    (".log", "Log file (may contain sensitive information)", "LOW"),
    (".cache", "Cache file", "INFO"),
)
# Manifests.
MANIFEST_NAMES = (
    ("package.json", "javascript", "npm/Node.js"),
    ("package-lock.json", "javascript", "npm lock file"),
    ("yarn.lock", "javascript", "Yarn lock file"),
    ("pnpm-lock.yaml", "javascript", "pnpm lock file"),
    ("requirements.txt", "python", "pip requirements"),
    ("Pipfile", "python", "Pipenv dependencies"),
    ("poetry.lock", "python", "Poetry lock file"),
    ("pyproject.toml", "python", "Python project config"),
    ("setup.py", "python", "Python setup file"),
    ("Cargo.toml", "rust", "Rust dependencies"),
    ("Cargo.lock", "rust", "Cargo lock file"),
    ("go.mod", "go", "Go module dependencies"),
    ("go.sum", "go", "Go module checksums"),
    ("Gemfile", "ruby", "Ruby dependencies"),
    ("Gemfile.lock", "ruby", "Ruby gem lock file"),
    ("composer.json", "php", "Composer dependencies"),
    ("composer.lock", "php", "Composer lock file"),
    ("pom.xml", "java", "Maven dependencies"),
    ("build.gradle", "java", "Gradle dependencies"),
)
# Manifests by suffix.
MANIFEST_SUFFIXES = (
    (".csproj", "csharp", "NuGet / .NET project"),
    ("packages.config", "csharp", "NuGet packages"),
)
# Schemes of SSH.
SSH_PREFIXES = (
    "git@", "ssh://",
)
# Other schemes.
OTHER_PREFIXES = (
    "https://", "http://", "git://",
)
# Known hosts.
KNOWN_HOSTS = (
    "github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "git.sr.ht", "gitea.com",
    "notabug.org", "framagit.org", "gitlab.gnome.org", "git.kernel.org", "sourcegraph.com",
)
# Npm advisories.
NPM_ADVISORIES = (
    ("lodash", "4.17.15", "CVE-2020-8203", "Prototype pollution in lodash", "HIGH"),
    ("lodash", "4.17.19", "CVE-2021-23337", "Command injection in lodash", "CRITICAL"),
    ("axios", "0.21.1", "CVE-2021-3749", "SSRF in axios", "HIGH"),
    ("moment", "2.29.1", "CVE-2022-24785", "Path traversal in moment.js", "MEDIUM"),
    ("webpack", "5.0.0", "CVE-2021-37873", "Path traversal in webpack", "MEDIUM"),
    ("minimist", "1.2.5", "CVE-2021-44906", "Prototype pollution", "HIGH"),
)
# Python advisories.
PYTHON_ADVISORIES = (
    ("urllib3", "1.25.10", "CVE-2021-28363", "HIGH"),
    ("cryptography", "3.3", "CVE-2020-25659", "MEDIUM"),
    ("pillow", "8.2.0", "CVE-2021-34552", "MEDIUM"),
)
# Minimum versions.
OUTDATED = (
    ("express", 4, "Express.js v3 is very old, upgrade to v4"),
    ("react", 16, "React v15 is EOL, upgrade to v16+"),
    ("react-dom", 16, "React-DOM v15 is EOL, upgrade to v16+"),
    ("angular", 8, "AngularJS (v1.x) is deprecated, consider Angular 2+"),
    ("django", 2, "Django 1.x is EOL, upgrade to Django 2+"),
    ("flask", 1, "Flask 0.x is very old, upgrade to 1+"),
    ("rails", 5, "Rails 4.x is EOL, upgrade to Rails 5+"),
    ("spring", 5, "Spring Framework 4.x is EOL, upgrade to Spring 5+"),
)
# Audit commands.
AUDITS = {
    "javascript": "npm audit",
    "python": "pip-audit or safety check",
    "rust": "cargo audit",
    "go": "govulncheck",
}
# The audit of other languages.
OTHER_AUDIT = "Use appropriate security scanner"
# Indicator patterns and whether case is ignored.
PATTERNS = {
    "email": (r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", True),
    "ipv4": (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", False),
    "uuid": (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", False),
    "base64": ("[A-Za-z0-9+/]{20,}={0,2}", False),
    "hex": ("[0-9a-f]{16,}", True),
    "url": (r"""https?://[^\s\"'<>]+""", True),
}
