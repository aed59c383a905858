"""Names, tokens and limits the results depend on."""

# Columns every wide table has, in output order.
PRIORITY_FIELDS = [
    "url_id",
    "source_url",
    "job_title",
    "company",
    "location",
    "salary_min",
    "salary_max",
    "currency",
    "employment_type",
    "experience_years",
    "remote_work",
    "required_skills",
    "education_level",
    "industry",
    "department",
]

# Columns always read as numbers.
NUMBER_FIELDS = ["salary_min", "salary_max", "experience_years"]

# Text that stands for null, compared exactly.
NULL_TOKENS = ["null", "None", "", "N/A", "n/a"]

# Text read as a boolean, compared in lower case without trimming.
TRUE_WORDS = ["true", "yes"]
FALSE_WORDS = ["false", "no"]

# Selectors for the main part of a page, tried in this order.
CONTENT_SELECTORS = [
    '[class*="job-description"]',
    '[class*="job-detail"]',
    '[class*="job-content"]',
    '[id*="job-description"]',
    '[id*="job-detail"]',
    ".job-description",
    ".job-details",
    ".job-content",
    ".description",
    "article",
    '[role="main"]',
    "main",
]

# Selectors compared in the page strategy profile.
PROFILE_SELECTORS = [
    '[class*="job-description"]',
    '[class*="job-detail"]',
    ".job-description",
    ".description",
    "article",
    "main",
]

# Fixed values: (text in the host name, selectors tried in order) for single sites.
SITE_SELECTORS = [
    ("linkedin.com", ['div[class*="jobs-description"]']),
    ("indeed.com", ['div[id="jobDescriptionText"]', 'div[class*="jobsearch-jobDescriptionText"]']),
    ("glassdoor.com", ['div[class*="jobDescriptionContent"]']),
    ("monster.com", ['div[class*="job-description"]']),
    ("angel.co", ['div[class*="job-description"]']),
    ("wellfound.com", ['div[class*="job-description"]']),
]

# Subtrees left out of page content, and out of the strategy profile.
CONTENT_DROPPED_TAGS = ["script", "style", "nav", "footer", "header"]
PROFILE_DROPPED_TAGS = ["script", "style"]

# Limits and texts.
MIN_CONTENT_LENGTH = 100
MIN_BLOCK_LENGTH = 50
MAX_CONTENT_LENGTH = 50_000
MIN_FIELD_FREQUENCY = 0.0
MISC_COLUMN = "misc_features"
MAX_MISC_ITEMS = 10
MAX_SAMPLES = 5
SAMPLE_LENGTH = 100
PREVIEW_LENGTH = 200
PROMPT_SEPARATOR = "\n\nJob Advertisement Content:\n"
NO_CONTENT = "No content extracted"
NO_REPLY = "No LLM response"
UNKNOWN_ERROR = "Unknown error"
NO_TITLE = "No title"
