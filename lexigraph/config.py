"""Tunable values. Every operator takes these as parameter defaults."""

# They must equal the specification for results to agree.
EMBEDDING_DIMENSIONS = 1024
EMBEDDING_BATCH_SIZE = 100
DUPLICATE_SIMILARITY = 0.90
REVIEW_SIMILARITY = 0.70
RELATED_HIGH_SIMILARITY = 0.85
RELATED_LOW_SIMILARITY = 0.65
ACCEPT_SIMILARITY = 0.92
CANDIDATE_LIMIT = 100

CHUNK_TARGET_TOKENS = 1500
CHUNK_MAX_TOKENS = 2000
CHUNK_OVERLAP_TOKENS = 200
TOKENS_PER_WORD = 1.3
RESULT_CACHE_DAYS = 7
EMBEDDING_CACHE_DAYS = 30
MAX_TEXT_LENGTH = 100_000
MIN_CONFIDENCE = 0.5
EXPANSION_FACTOR = 0.6
EXPANSION_DEPTH = 1

SIGNAL_THRESHOLD = 5
SIGNAL_GAP_DAYS = 30
PAIR_BATCH_SIZE = 15

PAGE_LIMIT = 20
PAGE_LIMIT_MAX = 100
CHANGELOG_LIMIT = 50
TRAVERSAL_DEPTH = 5
TRAVERSAL_DEPTH_MAX = 10
SLUG_MAX_LENGTH = 100
NAME_MAX_LENGTH = 200
DESCRIPTION_MAX_LENGTH = 5000
ALIAS_MAX_LENGTH = 200
BATCH_MAX_DOCUMENTS = 100

RATE_LIMITS = {"read": 100, "extract": 20, "mutate": 50}
DEBOUNCE_MS = 500
MAX_ATTEMPTS = 3
REANALYSIS_MAX_DOCUMENTS = 1000
SEARCH_BUCKETS = 64
COOCCURRENCE_EDGE_THRESHOLD = 20
COOCCURRENCE_NORMALIZATION = 100

GOLDEN_MIN_F1 = 0.80
GOLDEN_MIN_PRECISION = 0.75
GOLDEN_MIN_RECALL = 0.75

RRF_K = 60
TRIGRAM_THRESHOLD = 0.3

SKILL_STATUSES = ("candidate", "active", "deprecated", "merged")
CATEGORIES = ("domain", "tool", "certification", "soft_skill", "methodology", "language")
ALIAS_SOURCES = ("curated", "llm_discovered", "user_submitted")
EDGE_TYPES = ("parent_of", "child_of", "related_to", "requires", "superseded_by")
PROVENANCES = ("human_curated", "llm_predicted", "embedding_similarity", "empirical")
EDGE_STATUSES = ("active", "pending_review", "rejected", "deprecated")
QUEUE_STATUSES = ("pending", "approved", "rejected", "merged", "deferred")
MUTATION_TYPES = (
    "skill_created", "skill_updated", "skill_deprecated", "skill_merged", "alias_added",
    "alias_removed", "edge_created", "edge_updated", "edge_deprecated",
)

# Fixed values: (locale, display name) seeded on first load.
SEED_LOCALES = (
    ("en", "English"), ("vi", "Vietnamese"), ("fr", "French"), ("ja", "Japanese"), ("zh", "Chinese"),
)

# Fixed values: (name, slug, category) of the root concepts seeded on first load.
SEED_ROOTS = (
    ("Technology", "technology", "domain"), ("Business", "business", "domain"), ("Design", "design", "domain"),
    ("Science", "science", "domain"), ("Languages", "languages", "domain"), ("Soft Skills", "soft-skills", "domain"),
)

# Fixed values. Section rules: (document type, section type, weight, heading words).
SECTION_RULES = (
    ("jd", "requirements", 1.0, "requirements|qualifications"),
    ("jd", "responsibilities", 0.9, "responsibilities|duties"),
    ("jd", "nice_to_have", 0.75, "nice to have|nice-to-have|preferred"),
    ("jd", "company", 0.5, "about us|about the team|company description|about the company"),
    ("jd", "benefits", 0.3, "benefits|perks"),
    ("cv", "skills", 1.0, "skills"),
    ("cv", "experience", 0.9, "experience|work experience"),
    ("cv", "projects", 0.85, "projects"),
    ("cv", "education", 0.8, "education|certifications"),
    ("cv", "summary", 0.7, "summary|objective"),
)

# Allowed status changes of a skill.
TRANSITIONS = (
    ("candidate", "active"), ("active", "deprecated"), ("active", "merged"), ("deprecated", "active"),
)

# Scale guards (ours).
BROADCAST_MAX_ROWS = 500_000
NEST_PAGE_ROWS = 1_000
# Siblings listed by one task, tasks of a listing at most, and children that may be sent to all executors for it.
LISTED_TASK_ROWS = 10_000_000
LISTED_MAX_TASKS = 10_000
LISTED_BROADCAST_ROWS = 2_000_000
TAG_TASK_CHARS = 4_000_000
VECTOR_BLOCK_ROWS = 4_096
