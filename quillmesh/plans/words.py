"""Word lists with a fixed meaning."""

# Words that are no keywords.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "from", "as", "is", "was", "are", "were", "been", "be", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "must",
    "shall", "can", "need", "it", "its", "this", "that", "these", "those", "i", "you",
    "he", "she", "we", "they", "my", "your", "his", "her", "our", "their", "what",
    "which", "who", "whom", "when", "where", "why", "how", "all", "each", "every",
    "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "just", "also", "now", "here", "there",
    "fix", "bug", "issue", "error", "problem", "add", "update", "change", "modify",
    "create", "delete", "remove", "make", "get", "set", "use", "implement", "handle",
    "new", "old", "file", "code", "function", "method", "class", "module", "component",
    "please", "want", "work", "working", "broken", "doesn't", "don't",
    "isn't", "won't", "can't", "cannot", "unable", "able", "properly", "correctly",
]

# Words that are no symbols.
SYMBOL_STOPWORDS = [
    "up", "down", "run", "seed",
    "index", "show", "store", "create", "update", "destroy", "delete", "edit",
    "get", "set", "add", "remove", "find", "all", "first", "last",
    "boot", "init", "setup", "teardown", "handle", "invoke",
    "php", "ts", "tsx", "js", "jsx", "py", "rb", "go", "rs", "java", "vue", "svelte",
    "test", "it", "describe", "expect", "should", "assert",
    "new", "old", "data", "item", "items", "value", "values", "key", "keys",
    "name", "type", "id", "ids", "uuid", "slug",
]

# Words that indicate a kind of change, in order of precedence.
CHANGE_TYPES = {
    "bugfix": ["fix", "bug", "issue", "error", "broken", "crash", "fail", "wrong", "incorrect", "not working", "doesn't work"],
    "feature": ["add", "new", "feature", "implement", "create", "introduce", "support"],
    "refactor": ["refactor", "clean", "reorganize", "restructure", "simplify", "improve code", "extract", "move"],
    "perf": ["performance", "slow", "fast", "optimize", "speed", "efficient", "cache", "memory", "cpu"],
    "security": ["security", "vulnerability", "xss", "csrf", "injection", "auth", "permission", "access"],
}

# Domains and the words that indicate them.
DOMAINS = {
    "auth": ["auth", "authentication", "login", "logout", "session", "token", "jwt", "oauth", "password", "permission", "role", "credential", "sso", "saml", "2fa", "mfa"],
    "payments": ["payment", "stripe", "checkout", "charge", "invoice", "subscription", "billing", "price", "cart", "order", "webhook", "refund", "paypal", "transaction", "credit", "wallet"],
    "api": ["api", "endpoint", "route", "rest", "graphql", "request", "response", "controller", "middleware", "cors", "rate", "limit", "swagger", "openapi"],
    "database": ["database", "db", "query", "migration", "model", "schema", "table", "column", "index", "sql", "orm", "relation", "foreign", "seed", "factory"],
    "cache": ["cache", "redis", "memcache", "session", "store", "ttl", "invalidate", "flush", "memoize"],
    "queue": ["queue", "job", "worker", "dispatch", "listener", "event", "async", "background", "schedule", "cron"],
    "email": ["email", "mail", "smtp", "notification", "template", "send", "inbox", "mailer", "newsletter"],
    "storage": ["storage", "file", "upload", "download", "s3", "disk", "filesystem", "image", "media", "asset", "attachment"],
    "testing": ["test", "spec", "mock", "stub", "fixture", "assert", "expect", "unit", "integration", "e2e", "coverage"],
    "security": ["security", "xss", "csrf", "injection", "sanitize", "escape", "validate", "encrypt", "decrypt", "hash", "vulnerability", "firewall"],
    "performance": ["performance", "slow", "fast", "optimize", "speed", "latency", "cache", "index", "query", "n+1", "profil"],
    "ui": ["ui", "component", "view", "template", "frontend", "css", "style", "layout", "form", "button", "modal"],
    "chat": ["chat", "message", "messaging", "conversation", "inbox", "dm", "direct", "unlock", "thread", "realtime", "websocket", "pusher"],
    "moderation": ["report", "ban", "suspend", "dispute", "flag", "moderate", "block", "abuse", "spam", "review"],
    "sms": ["sms", "text", "mobile", "phone", "otp", "verification", "twilio", "nexmo", "vonage", "pin"],
    "search": ["search", "query", "filter", "sort", "elasticsearch", "algolia", "meilisearch", "fulltext"],
    "export": ["export", "report", "csv", "excel", "pdf", "download", "generate"],
    "localization": ["i18n", "l10n", "translation", "locale", "language", "translate", "multilingual"],
    "logging": ["log", "logging", "monitor", "debug", "trace", "audit", "sentry", "bugsnag"],
}
