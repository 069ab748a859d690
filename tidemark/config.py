"""Weights, lanes and word lists. All of it is plain configuration.

Everything here is small and known on the driver, so operators fold it into
literal expressions instead of joining configuration tables at run time.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

READER_ZONE = "America/New_York"
MARKET_ZONE = "America/New_York"

# Lane ids in their declared order, and the lane that is never capped.
LANES = (
    "deadlines",
    "fellowships",
    "mstp-labs",
    "venture-founder",
    "conferences",
    "causal-genetics",
    "tools-platforms",
)
PINNED_LANE = "deadlines"
DEFAULT_NEWS_LANE = "causal-genetics"
JOB_LANE = "venture-founder"

# Enumerations.
STATUSES = ("active", "watch", "ruled-out", "closed", "submitted", "won")
KINDS = ("confirmed", "projected", "rolling", "unknown")
PRECISIONS = ("minute", "day", "month", "unknown")
CADENCES = ("annual", "biennial", "thrice-yearly", "none")


@dataclass(frozen=True)
class Weights:
    """Scoring numbers. The defaults are fixed values that results depend on."""

    version: str = "2026-08-22.1"
    points: Mapping[str, float] = field(
        default_factory=lambda: {
            "deadlineUrgency": 30.0,
            "lexicon": 22.0,
            "gating": 16.0,
            "event": 14.0,
            "fit": 14.0,
            "authority": 10.0,
            "recency": 8.0,
            "corroboration": 5.0,
        }
    )
    penalties: Mapping[str, float] = field(
        default_factory=lambda: {
            "eligibilityMismatch": 25.0,
            "offTopic": 8.0,
            "thinContent": 6.0,
            "dateMissing": 5.0,
            "deadlineUnknown": 4.0,
            "deadlineProjected": 3.0,
        }
    )
    recency_half_life_hours: Mapping[str, float] = field(
        default_factory=lambda: {
            "deadlines": 999999.0,
            "fellowships": 336.0,
            "mstp-labs": 336.0,
            "conferences": 336.0,
            "venture-founder": 168.0,
            "causal-genetics": 96.0,
            "tools-platforms": 48.0,
        }
    )
    default_half_life_hours: float = 96.0
    max_age_days: Mapping[str, float] = field(
        default_factory=lambda: {
            "deadlines": 3650.0,
            "fellowships": 3650.0,
            "conferences": 3650.0,
            "mstp-labs": 120.0,
            "venture-founder": 45.0,
            "causal-genetics": 21.0,
            "tools-platforms": 10.0,
        }
    )
    default_max_age_days: float = 14.0
    horizon_days: Mapping[str, float] = field(
        default_factory=lambda: {
            "deadlines": 400.0,
            "fellowships": 400.0,
            "mstp-labs": 400.0,
            "conferences": 240.0,
            "venture-founder": 180.0,
            "causal-genetics": 0.0,
            "tools-platforms": 0.0,
        }
    )
    default_horizon_days: float = 400.0
    lead_days: Mapping[str, float] = field(
        default_factory=lambda: {
            "deadlines": 45.0,
            "fellowships": 35.0,
            "mstp-labs": 60.0,
            "conferences": 21.0,
            "venture-founder": 30.0,
            "causal-genetics": 30.0,
            "tools-platforms": 30.0,
        }
    )
    default_lead_days: float = 35.0
    steepness: float = 2.2
    grace_days: int = 2
    projected_confidence: float = 0.7
    rolling_floor: float = 0.25
    unknown_floor: float = 0.35
    month_confidence: float = 0.6
    rungs: tuple[int, ...] = (365, 180, 90, 60, 45, 30, 21, 14, 10, 7, 6, 5, 4, 3, 2, 1, 0)
    rung_floor_days: int = 7
    rolling_redelivery_days: int = 45
    strip_days: int = 60
    escalation_days: int = 14
    verify_every_days: int = 90
    lexicon_saturation: float = 8.0
    keep_threshold: float = 22.0
    max_items_per_day: int = 42
    max_items_per_lane: int = 6
    event_boosts: Mapping[str, float] = field(
        default_factory=lambda: {
            "deadline-imminent": 1.0,
            "cycle-opened": 0.95,
            "verify-deadline": 0.9,
            "step-due": 0.85,
            "eligibility-changed": 0.8,
            "new-program": 0.7,
            "page-changed": 0.55,
            "role-posted": 0.5,
            "cohort-announced": 0.4,
            "deadline-passed": 0.2,
            "major-journal-primary": 0.7,
            "preprint": 0.3,
            "financing": 0.35,
            "ma": 0.5,
            "approval": 0.6,
            "readout": 0.5,
            "personnel": 0.25,
            "opinion": 0.0,
        }
    )

    def fingerprint(self) -> str:
        """Twelve hex digits that change whenever any weight does."""
        text = json.dumps(dataclasses.asdict(self), sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:12]


WEIGHTS = Weights()


@dataclass(frozen=True)
class Term:
    term: str
    weight: float


@dataclass(frozen=True)
class Lexicon:
    """Weighted terms per lane plus case-sensitive acronyms shared by every lane.

    A lexicon is configuration: its terms become literals of the plan. For term
    lists of any size there is ``operators.terms``, which takes them as a table.
    """

    lanes: Mapping[str, tuple[Term, ...]]
    acronyms: tuple[Term, ...] = ()
    min_term_length: int = 4

    def lane_terms(self, lane: str) -> tuple[Term, ...]:
        return tuple(t for t in self.lanes.get(lane, ()) if len(t.term) >= self.min_term_length)

    def high_signal(self, floor: float = 3.0) -> list[str]:
        return sorted({t.term.lower() for ts in self.lanes.values() for t in ts if t.weight >= floor})


# Lane word lists with their weights.
LEXICON = Lexicon(
    lanes={
        "deadlines": (),
        "fellowships": (
            Term("fellowship", 2),
            Term("scholarship", 2),
            Term("scholars program", 2.5),
            Term("call for applications", 3),
            Term("applications are open", 3),
            Term("applications open", 3),
            Term("now accepting applications", 3),
            Term("cohort", 1.5),
            Term("stipend", 2),
            Term("rhodes", 2.5),
            Term("marshall scholarship", 2.5),
            Term("gates cambridge", 3),
            Term("knight-hennessy", 3),
            Term("hertz", 2.5),
            Term("soros", 2.5),
            Term("schmidt science", 2.5),
            Term("gilliam", 2.5),
        ),
        "mstp-labs": (
            Term("md/phd", 3),
            Term("md-phd", 3),
            Term("medical scientist training", 3),
            Term("physician scientist", 2.5),
            Term("physician-scientist", 2.5),
            Term("mstp", 3),
            Term("amcas", 2.5),
            Term("post-baccalaureate", 2),
            Term("postbac", 2),
            Term("kirschstein", 2.5),
            Term("f30", 3),
            Term("t32", 2),
        ),
        "venture-founder": (
            Term("entrepreneur in residence", 3),
            Term("founder in residence", 3.5),
            Term("scientific co-founder", 3.5),
            Term("scientific cofounder", 3.5),
            Term("company creation", 2.5),
            Term("venture fellow", 3),
            Term("seed round", 1.5),
            Term("series a", 1.5),
            Term("spinout", 2),
            Term("incubator", 1.5),
            Term("accelerator", 1.5),
            Term("focused research organization", 3),
            Term("nucleate", 2.5),
            Term("flagship pioneering", 2.5),
            Term("third rock", 2),
            Term("atlas venture", 2),
            Term("arch venture", 2),
            Term("convergent research", 3),
            Term("translational", 1),
        ),
        "conferences": (),
        "causal-genetics": (
            Term("mendelian randomization", 4),
            Term("mendelian randomisation", 4),
            Term("causal inference", 3),
            Term("causal variant", 3.5),
            Term("genome-wide association", 3.5),
            Term("fine-mapping", 3.5),
            Term("fine mapping", 3),
            Term("colocalization", 3.5),
            Term("colocalisation", 3.5),
            Term("burden test", 3),
            Term("rare variant", 2.5),
            Term("polygenic", 2.5),
            Term("heritability", 2),
            Term("target discovery", 3.5),
            Term("target identification", 3),
            Term("genetic evidence", 3),
            Term("human genetics", 2.5),
            Term("biobank", 2.5),
            Term("exome", 2),
            Term("perturbation screen", 3.5),
            Term("perturb-seq", 3.5),
            Term("crispr screen", 3),
            Term("functional genomics", 3),
            Term("single-cell", 2.5),
            Term("single cell", 2),
            Term("spatial transcriptomics", 2.5),
            Term("epigenom", 3),
            Term("epigenetic editing", 4),
            Term("epigenetic clock", 3.5),
            Term("dna methylation", 3.5),
            Term("methylome", 3),
            Term("bisulfite", 3),
            Term("chromatin", 2.5),
            Term("chromatin accessibility", 3),
            Term("3d genome", 2.5),
            Term("enhancer", 2),
            Term("regulatory element", 2.5),
            Term("transcription factor", 2),
            Term("reprogramming", 3),
            Term("partial reprogramming", 3.5),
            Term("yamanaka", 3),
            Term("biomarkers of aging", 3.5),
            Term("biological age", 3),
            Term("healthspan", 2.5),
            Term("senescence", 2),
            Term("longevity", 2),
            Term("aging", 1.5),
        ),
        "tools-platforms": (
            Term("sequencing platform", 3),
            Term("long-read", 2.5),
            Term("nanopore", 2.5),
            Term("illumina", 2),
            Term("10x genomics", 3),
            Term("pacific biosciences", 2.5),
            Term("spatial platform", 2.5),
            Term("consumable", 2),
            Term("instrument", 1.5),
            Term("assay", 1.5),
            Term("throughput", 1.5),
            Term("gross margin", 2),
            Term("pull-through", 2.5),
            Term("razor", 1.5),
            Term("diagnostics", 1.5),
            Term("laboratory developed test", 2.5),
            Term("reimbursement", 2),
            Term("tech transfer", 2.5),
            Term("licensing deal", 2),
            Term("royalty", 2),
        ),
    },
    acronyms=(
        Term("GWAS", 3),
        Term("MR", 1.5),
        Term("QTL", 2),
        Term("eQTL", 3),
        Term("pQTL", 3),
        Term("sQTL", 2.5),
        Term("PRS", 2),
        Term("PheWAS", 3),
        Term("TWAS", 3),
        Term("ATAC", 3),
        Term("TAPS", 3),
        Term("WGBS", 2.5),
        Term("scRNA", 2),
        Term("CUT&RUN", 2),
        Term("CRISPRi", 2.5),
        Term("CRISPRa", 2.5),
        Term("UKB", 2),
        Term("LDSC", 2.5),
    ),
)

# Titles that are never shown.
VETO_PATTERNS = (
    r"\bcorrection\b|\berratum\b|\bretraction\b",
    r"\bbook review\b|\bobituary\b|\bcorrespondence\b",
    r"\bnature futures\b|\bscience fiction\b",
    r"\bjob alert digest\b",
    r"\bwebinar recording\b",
)

# Watched tickers, and capitalised words that are not tickers.
WATCHED_TICKERS = tuple(
    """
    LLY NVO PFE MRK ABBV AZN NVS JNJ BMY GILD AMGN SNY GSK
    ILMN TXG PACB TMO DHR A QGEN BRKR NTRA EXAS TEM GRAL
    VRTX ALNY IONS REGN BEAM NTLA VERV CRSP RXRX SDGR
    BIOA UBX
    """.split()
)
NOT_TICKERS = tuple("FDA PDUFA ADCOM ADCOMM EMA NDA BLA SBLA ANDA CRL US USA EU UK TBD TBA".split())
EVENT_HORIZON_DAYS = 365

# Words dropped from content tokens.
TOKEN_STOPWORDS = tuple(
    """
    a an and are as at be but by for from has have in into is it its of on or that the their this
    to was were will with after over new says say said amid up down out not no
    """.split()
)

# Capitalised words that are not names, for the grounding check.
CAPITALISED_STOPWORDS = tuple(
    sorted(
        set(
            """
            the this that these those and but or so yet if when while where what which who whose with
            without after before between beyond by for from in into on of off out over to under up upon
            at as it its he his she her they their you your we our my one two three four five six seven
            eight nine ten today tomorrow yesterday now then there here everything nothing something
            anything both either neither each every all most more less least only just still also even
            once twice next last first second third final meanwhile however otherwise instead because
            since until though although unless note watch keep read start begin expect remember consider
            treat plan write applications application deadlines deadline no yes not do does did is are
            was were be been being have has had will would can could should must may might none new
            another other same such about against along among around behind below beside despite during
            except inside near outside past than through toward within
            """.split()
        )
    )
)

# Spelled-out numbers.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90,
}
CANDIDATE_MAX_CHARS = 700

# HTML entity names seen in feeds.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "hellip": "…", "middot": "·", "deg": "°", "plusmn": "±", "times": "×",
    "eacute": "é", "egrave": "è", "uuml": "ü", "ouml": "ö", "auml": "ä",
    "ccedil": "ç", "szlig": "ß",
}

# URL rules.
TRACKING_PARAM = (
    r"^(utm_\w+|mc_\w+|mkt_\w+|_hs\w*|hsa_\w+|ref|ref_src|referrer|fbclid|gclid|gbraid|wbraid|igshid"
    r"|mibextid|cmpid|campaign|source|spm|rss|feed|at_\w+|ito|smid|partner)$"
)
HTTPS_ONLY_HOSTS = ("www.fda.gov", "fda.gov")
HOST_ALIASES = {
    "endpts.com": "endpoints.news",
    "www.endpts.com": "endpoints.news",
    "www.endpoints.news": "endpoints.news",
}

# Markers of a bot wall or error page, in the order they are tried.
CHALLENGE_MARKERS = (
    (r"just a moment", "Cloudflare"),
    (r"attention required", "Cloudflare"),
    (r"checking your browser", "Cloudflare"),
    (r"cf-browser-verification|__cf_chl|cf_chl_opt", "Cloudflare"),
    (r"client challenge", "F5/Shape"),
    (r"_incapsula_|incapsula incident", "Imperva"),
    (r"access denied|request blocked", "WAF"),
    (r"enable javascript and cookies to continue", "bot wall"),
    (r"<title[^>]*>\s*(403|forbidden|error)\s*<", "error page"),
)

# Sentence contexts in which a date is not a deadline, by the code of what it is instead; the first counts.
REFUSE_CONTEXTS = (
    (r"\b(were|was)\s+announced\b|\bannounced\s+on\b|\bwere\s+named\b", "announcement"),
    (r"\bclosed\s+on\b|\bhave\s+closed\b|\bhas\s+closed\b", "closed-cycle"),
    (r"\bbegin\s+their\s+studies\b|\bcommences?\b|\bstart\s+date\b", "award-start"),
    (r"\blast\s+updated\b|\bcopyright\b|©", "page-metadata"),
    (r"\bwas\s+founded\b|\bsince\s+\d{4}\b|\bhas\s+supported\b", "history"),
    (r"\binformation\s+session\b|\bwebinar\b|\bopen\s+house\b", "event"),
    (
        r"\bnotifications?\s+(?:go|are)\b|\bdecisions?\s+(?:will\s+be\s+)?announced\b|\baward\s+notifications?\b",
        "notification",
    ),
    (r"\bcouncil\s+round\b|\breview\s+(?:meets|panel)\b", "review"),
    (r"\breviewed\s+annually\b|\btypically\s+held\b", "habit"),
    (r"\boffice\s+is\s+closed\b|\bholiday\b", "office-closed"),
    (r"\bif\s+you\s+require\b|\baccommodations?\b", "accessibility"),
)
DEADLINE_CUE = (
    r"\b(deadline|closes?|closing|due|apply\s+by|applications?\s+(?:close|are\s+due)|submissions?\s+close"
    r"|submit\s+by|must\s+be\s+(?:received|submitted)|no\s+later\s+than)\b"
)
#: What the codes of the reader say to a person.
READER_WORDING = {
    "empty": "nothing was quoted",
    "too-long": "longer than a sentence",
    "announcement": "tells of an announcement",
    "closed-cycle": "tells of a cycle that is over",
    "award-start": "tells when the award begins",
    "page-metadata": "belongs to the page, not to the programme",
    "history": "tells of the past",
    "event": "invites to an event",
    "notification": "tells when answers come",
    "review": "tells when reviewers meet",
    "habit": "tells what is usual",
    "office-closed": "tells when the office is shut",
    "accessibility": "offers help with access",
    "no-cue": "does not say that anything is due",
    "no-year": "names no year",
    "no-date": "names no whole date",
    "no-such-day": "names a day that does not exist or lies too far off",
    "other-cycle": "names a year of another cycle",
}
# Lead-ins of abstracts (journal names and status phrases), and first words of lines that say nothing.
JOURNAL_NAMES = ("nature", "science", "cell")
JOURNAL_STATUS = ("published online", "advance online publication", "available online")
EMPTY_LINE_STARTS = (
    "sign up", "subscribe", "read more", "continue reading", "follow us", "share this", "editor's note", "editors note",
    "editor’s note", "this article", "photo", "image", "credit", "advertisement", "©", "all rights reserved", "get the latest",
    "listen to", "watch:",
)
# Accepted month names.
MONTH_NAMES = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4,
    "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}


# Short zone names by (zone, offset minutes); other zones print as GMT+h.
ZONE_NAMES = {
    ("America/New_York", -300): "EST",
    ("America/New_York", -240): "EDT",
    ("America/Chicago", -360): "CST",
    ("America/Chicago", -300): "CDT",
    ("America/Denver", -420): "MST",
    ("America/Denver", -360): "MDT",
    ("America/Los_Angeles", -480): "PST",
    ("America/Los_Angeles", -420): "PDT",
    ("Europe/London", 0): "GMT",
    ("Europe/London", 60): "BST",
    ("Europe/Berlin", 60): "CET",
    ("Europe/Berlin", 120): "CEST",
    ("Europe/Copenhagen", 60): "CET",
    ("Europe/Copenhagen", 120): "CEST",
    ("UTC", 0): "UTC",
}
