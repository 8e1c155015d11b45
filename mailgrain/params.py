"""Parameters of every scorer: word lists, patterns, weights and thresholds.

All lists are fields of the frozen :class:`Params`, so a caller can replace any
of them with :func:`dataclasses.replace`; the defaults below are fixed values
that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# Message text rules
# --------------------------------------------------------------------------
SPAM_KEYWORDS = (
    "free", "winner", "congratulations", "urgent", "act now", "limited time",
    "click here", "guarantee", "no risk", "money back", "special promotion",
    "exclusive offer", "unsubscribe", "remove", "opt out", "viagra",
    "pharmacy", "loan", "debt", "credit", "investment", "casino", "lottery",
)
HAM_KEYWORDS = (
    "meeting", "appointment", "schedule", "conference", "team", "project",
    "deadline", "report", "document", "invoice", "receipt", "order",
    "shipping", "delivery",
)
MONEY_PATTERNS = (
    r"\$\d+", r"\d+\s*dollars?", r"\d+\s*euros?", r"free\s+money",
    r"cash\s+prize", r"win\s+\$",
)
SHORTENER_PATTERNS = (
    r"bit\.ly", r"tinyurl", r"goo\.gl", r"t\.co", r"ow\.ly", r"is\.gd",
)
URGENCY_PATTERNS = (
    r"urgent", r"immediate", r"expires?\s+(today|tomorrow|soon)",
    r"limited\s+time", r"act\s+now", r"hurry", r"don\'?t\s+wait",
)
OPT_OUT_PATTERNS = (
    r"unsubscribe", r"opt\s+out", r"remove\s+me", r"stop\s+emails?",
    r"email\s+preferences", r"manage\s+subscription",
)
UNSUBSCRIBE_PATTERNS = (
    r"unsubscribe", r"opt[\s-]?out", r"remove[\s-]?me", r"stop[\s-]?emails?",
    r"email[\s-]?preferences", r"manage[\s-]?subscription",
)
DISPOSABLE_SENDERS = (
    "tempmail", "guerrillamail", "10minutemail", "mailinator", "throwaway",
    "temp-mail", "yopmail", "getairmail",
)
REPUTABLE_SENDERS = (
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "aol.com",
    "icloud.com", "protonmail.com", "company.com",
)
UNSUBSCRIBE_URL_WORDS = ("unsubscribe", "opt-out", "remove", "stop", "preferences")

# --------------------------------------------------------------------------
# URL rules
# --------------------------------------------------------------------------
PHISHING_KEYWORDS = (
    "urgent", "immediate", "click here", "act now", "limited time",
    "verify account", "suspended", "expires today", "winner",
    "congratulations", "free money", "claim now", "deposit", "wire transfer",
    "bitcoin", "cryptocurrency",
)
SUSPICIOUS_TLDS = (
    ".tk", ".ml", ".ga", ".cf", ".top", ".click", ".download", ".accountant",
    ".racing", ".cricket", ".science", ".work",
)
SHORTENER_HOSTS = (
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly",
    "adf.ly", "short.link", "tiny.cc",
)
TRUSTED_NAMES = ("google", "microsoft", "apple", "amazon", "paypal", "bank")
POPULAR_HOSTS = (
    "google.com", "facebook.com", "microsoft.com", "amazon.com", "paypal.com",
    "apple.com", "netflix.com", "instagram.com",
)
# Cyrillic letters that look like Latin a, e, o, p, c, y, x.
LOOKALIKE_LETTERS = "аеорсух"
REDIRECT_STATUSES = (301, 302, 303, 307, 308)

# Advice texts by risk level and by finding.
ADVICE_BY_LEVEL = {
    "severe": (
        "⚠️ DO NOT CLICK this link - high security risk detected",
        "Block this URL and report as malicious",
        "Warn other users about this threat",
    ),
    "medium": (
        "⚠️ Exercise caution with this link",
        "Verify the source before clicking",
        "Consider using URL scanning services",
    ),
    "low": (
        "Use standard web security practices",
        "Verify the website's legitimacy if unsure",
    ),
    "minimal": (
        "✅ URL appears to be safe",
        "Follow standard security practices",
    ),
}
ADVICE_SHORTENER = "URL shortener detected - expand URL to see final destination"
ADVICE_IP_HOST = "IP address used instead of domain - potentially suspicious"
ADVICE_PHISHING = "Phishing indicators detected - verify sender authenticity"

# --------------------------------------------------------------------------
# Text normalisation for the models (public English lists)
# --------------------------------------------------------------------------
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your
    yours yourself yourselves he him his himself she she's her hers herself it
    it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after
    above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don
    don't should should've now d ll m o re ve y ain aren aren't couldn couldn't
    didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't
    ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
    shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)
JOINED_FORMS = {
    "cannot": "can not", "gimme": "gim me", "gonna": "gon na",
    "gotta": "got ta", "lemme": "lem me", "wanna": "wan na",
}

# Model weights in the weighted vote.
ENSEMBLE_WEIGHTS = {
    "naive_bayes": 0.4,
    "random_forest": 0.35,
    "logistic_regression": 0.25,
}


@dataclass(frozen=True)
class Params:
    """One immutable set of lists, weights and thresholds."""

    # rule scorer
    spam_keywords: tuple[str, ...] = SPAM_KEYWORDS
    ham_keywords: tuple[str, ...] = HAM_KEYWORDS
    money_patterns: tuple[str, ...] = MONEY_PATTERNS
    shortener_patterns: tuple[str, ...] = SHORTENER_PATTERNS
    urgency_patterns: tuple[str, ...] = URGENCY_PATTERNS
    opt_out_patterns: tuple[str, ...] = OPT_OUT_PATTERNS
    disposable_senders: tuple[str, ...] = DISPOSABLE_SENDERS
    reputable_senders: tuple[str, ...] = REPUTABLE_SENDERS
    spam_score_threshold: float = 2.0

    # unsubscribe handling
    unsubscribe_patterns: tuple[str, ...] = UNSUBSCRIBE_PATTERNS
    unsubscribe_url_words: tuple[str, ...] = UNSUBSCRIBE_URL_WORDS
    auto_unsubscribe: bool = True

    # URL scoring
    suspicious_tlds: tuple[str, ...] = SUSPICIOUS_TLDS
    shortener_hosts: tuple[str, ...] = SHORTENER_HOSTS
    trusted_names: tuple[str, ...] = TRUSTED_NAMES
    popular_hosts: tuple[str, ...] = POPULAR_HOSTS
    phishing_keywords: tuple[str, ...] = PHISHING_KEYWORDS
    lookalike_letters: str = LOOKALIKE_LETTERS
    max_redirects: int = 10

    # batch selection and gate
    batch_size: int = 100
    days_back: int = 7
    confidence_threshold: float = 0.85

    # models
    stop_words: tuple[str, ...] = STOP_WORDS
    vocabulary_size: int = 5000
    min_df: int = 2
    max_df: float = 0.95
    test_fraction: float = 0.2
    seed: int = 42
    trees: int = 100
    tree_depth: int = 30  # the most that MLlib's trees allow
    training_partitions: int | None = None  # None: as the training data comes, small ones put together
    max_iter: int = 1000
    smoothing_in_ensemble: float = 1.0
    smoothing_alone: float = 0.1


DEFAULTS = Params()
