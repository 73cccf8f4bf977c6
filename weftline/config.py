"""Parameters of the site analytics, with the limits that settings are held to, and its fixed word lists."""

from __future__ import annotations

from dataclasses import dataclass

# Words that carry no meaning of their own, left out of term statistics.
STOPWORDS = (
    "the and for are but not you all any can her was one our out his has had how who its did yes get got why let put too use she him now new way may say see two man day "
    "this that with from they will would there their what about which when were your have more than then them some into only other such also just over most been being "
    "because these those here very much many each both after before where while should could does doing done between through during above below again further once under "
    "same own off down upon within without"
).split()
# Words that no anchor begins or ends with.
EDGE_STOPWORDS = (
    "the a an and or but of in on to for with by at from as into their its his her our your this that these those is are was were be been how what why when which who "
    "them they it than then over under about"
).split()
# Words that make a phrase structural.
NOISE_WORDS = ("part", "parts", "vol", "volume", "chapter", "edition", "section", "no")
# Single words of titles that say nothing of a page.
GENERIC_WORDS = ("guide", "review", "tips", "best", "introduction", "overview", "about", "guidelines")
#: What reasons for a link that could not be set mean to a reader.
REASONS = (
    ("suggest_only", "made with a page builder, set it by hand"), ("unsupported_system", "content of this kind is not written to"), ("modified_since", "changed since the scan"),
    ("bad_status", "applied already, or just being"), ("anchor_not_found", "the words are gone from the page"), ("empty_anchor", "without anchor"), ("not_found", "the proposal is gone"),
    ("source_missing", "the page is gone"), ("no_target", "the target has no address"), ("integrity_check_failed", "visible text would have changed"), ("blocks_unavailable", "blocks can not be read"),
    ("ledger_failed", "no record for undoing could be made"), ("update_failed", "the page could not be stored"),
)
# Anchors that say nothing of their target.
GENERIC_ANCHORS = ("click here", "read more", "here", "this", "learn more", "more", "link", "this page", "continue reading")
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "vs", "etc", "eg", "ie", "fig", "no", "vol", "pp", "approx", "inc", "ltd", "co")
# Marks and lower-case phrases that make a sentence a question.
QUESTION_MARKS = ("?", "\u061f", "\u0e56", "\u2047", "\uff1f")
QUESTION_PHRASES = (
    "answer:", "assertion (a)", "choose the correct", "codes:", "consider the following", "explanation:", "given below", "how many of the above", "match list", "reason (r)",
    "select the correct", "statement 1", "statement i:", "the correct answer is", "which of the following", "which one of the following", "with reference to",
)
# Click-through rates of the first ten ranks.
CLICK_RATES = (0.28, 0.15, 0.11, 0.08, 0.06, 0.048, 0.039, 0.032, 0.028, 0.025)
# Cents for a million tokens in and out, in order of precedence.
PRICES = (
    ("openai/gpt-4o-mini", 15.0, 60.0),
    ("openai/gpt-4o", 250.0, 1000.0),
    ("anthropic/claude-haiku", 80.0, 400.0),
    ("anthropic/claude-sonnet", 300.0, 1500.0),
    ("anthropic/claude-opus", 1500.0, 7500.0),
    ("gemini/gemini-1.5-flash", 7.5, 30.0),
)
DEFAULT_PRICE = (50.0, 150.0)
# Shapes of secrets in messages, those of known vendors first.
SECRET_SHAPES = (
    r"\bsk-ant-[A-Za-z0-9_\-]{16,}",
    r"\bsk-[A-Za-z0-9_\-]{16,}",
    r"\bAIza[A-Za-z0-9_\-]{20,}",
    r"\bgsk_[A-Za-z0-9]{16,}",
    r"\bxai-[A-Za-z0-9]{16,}",
    r"\bpplx-[A-Za-z0-9]{16,}",
    r"\bhf_[A-Za-z0-9]{16,}",
    r"\br8_[A-Za-z0-9]{16,}",
    r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}",
    r"\b[A-Za-z0-9_\-]{40,}\b",
)


@dataclass(frozen=True)
class EngineConfig:
    """Settings; values out of range are moved to the nearest that is allowed."""

    max_links_per_1000: int = 5
    min_relevance: float = 0.08
    max_suggestions: int = 8
    min_anchor_words: int = 2
    max_anchor_words: int = 4
    stored_terms: int = 300
    source_terms: int = 40
    df_ceiling: float = 0.4
    min_shared: int = 2
    keyword_pool: int = 500

    def __post_init__(self):
        for name, low, high in (("max_links_per_1000", 1, 20), ("min_relevance", 0, 1), ("max_suggestions", 1, 50), ("min_anchor_words", 1, 4)):
            object.__setattr__(self, name, min(high, max(low, getattr(self, name))))
        object.__setattr__(self, "max_anchor_words", min(6, max(self.min_anchor_words, self.max_anchor_words)))
