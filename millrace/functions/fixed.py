"""Word lists, hosts and constants that define results.  Do not change them."""

# Queries: words without weight in lexical matching, and words that only modify a question.
LEXICAL_STOP = "and any current data documentation for from guideline guidelines latest newest official original paper recent recently recommendation recommendations standards the today with".split()
MODIFIERS = "best a an are can could current currently did do documentation does how i is latest me my newest official recent recently should the today traditional was were what when where which why would".split()
NEWS_DROPPED = "news headline headlines today yesterday breaking latest recent recently from about".split()
DATE_INTRODUCTIONS = "as during from in on since".split()

# Intent.
STRONG_BRANDS = "android api aspnet aws axum azure bazel compiler crdt csharp cuda dart database docker dotnet ec2 flutter gcp github golang ios javascript kotlin kubernetes lambda laravel linux mysql nix nixos nodejs pants php postgres postgresql redis s3 scala sdk serde sql sqlite terraform tokio typescript valkey".split()
BRAND_SPELLINGS = ["next.js", "c++", "c#", ".net"]
AMBIGUOUS_BRANDS = "go java node python r rails react ruby rust spring swift".split()
TECHNICAL_CONTEXT = "api async await borrow class cli code coding config configuration context coroutine crate database dependency deploy docs documentation endpoint enum error exception framework function goroutine hashmap interface library method middleware module package pathlib pointer programming request response runtime sdk serialization server sql struct test trait typeerror useeffect".split()
EXPLICIT_SCHOLARLY = "arxiv clinical doi journal preprint pubmed trial trials".split()
SCHOLARLY_PAIRS = ["meta analysis", "systematic review", "randomized trial"]
DISTINCTIVE_SUBJECTS = "astrophysics cas9 crispr epidemiology exoplanet genome genomic genomics jwst neuroscience polymerase proteomics quantum spectroscopy stoichiometry superconductor".split()
BROAD_SUBJECTS = "astronomy biology cancer cardiology chemistry climate diabetes ecology genetics geology hypertension materials medicine medical oncology pharmacology physics protein".split()
SCHOLARLY_WORDS = "arxiv doi journal paper papers preprint pubmed research study studies".split()
RESEARCH_CUES = "evidence experiment guideline guidelines mechanism recommendation recommendations standards".split()
EXPLICIT_NEWS = "news headline headlines breaking".split()
FRESHNESS = "current latest newest recent recently today".split()
EVENTS = "advisory announcement breach incident launch launched mission outage release security status update vulnerability".split()
RESEARCH_WORDS = "evidence paper papers preprint preprints reproducibility research".split()
FULL_TEXT_FEATURES = "index indexes indexing search searchable searches searching".split()
RECENCY = "breaking headline headlines latest news newest recent recently today".split()
TEMPORAL_NOUNS = "cpi data date advisory inflation mission price rate security status update version vulnerability weather".split()
STRICT_PHRASES = ["primary source", "release notes", "first-party", "first party", "upstream documentation", "upstream docs", "vendor documentation", "vendor docs"]
DIAGNOSTIC_WORDS = "error exception failed failure invalid not unable unauthorized".split()
ERROR_CODE_PREFIXES = "E C CS FS TS GHC LNK".split()
DIAGNOSTIC_MARKERS = "cannot denied error exception excessively failed failure invalid mismatch panic unable unauthorized undefined unexpected unresolved unsupported".split()
NOT_DIAGNOSTICS = ["must not", "not authorized", "not found", "not implemented", "not satisfied", "not supported"]
DIAGNOSTIC_STOP = "a after an and before because error example fix for from in into is of on the to using when while with workaround".split()
COMPANION_STOP = "and error for from import into rust the using with".split()
ACTIONS = "advised avoid avoided consider considered goal indicated initiate initiated must offer offered prescribe prescribed reasonable receive recommended recommends should start started target use".split()
ISSUERS = {
    "aan": ["american", "academy", "neurology"],
    "acc": ["american", "college", "cardiology"],
    "acog": ["american", "college", "obstetricians", "gynecologists"],
    "ada": ["american", "diabetes", "association"],
    "aha": ["american", "heart", "association"],
    "cdc": ["centers", "disease", "control", "prevention"],
    "esc": ["european", "society", "cardiology"],
    "kdigo": ["kidney", "disease", "improving", "global", "outcomes"],
    "nice": ["national", "institute", "health", "care", "excellence"],
    "nih": ["national", "institutes", "health"],
    "uspstf": ["preventive", "services", "task", "force"],
    "who": ["world", "health", "organization"],
}

# Dates.
MONTHS = {"january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12}
FIRST_YEAR, LAST_YEAR = 1900, 2200

# Titles.
TITLE_STOP = "a an and against at by for from how in into of on or the to using with".split()
RESPONSE_PREFIXES = ["comment on:", "comment on ", "comment:", "comments on ", "fwd:", "fw:", "re:", "reply to:", "reply to ", "reply:", "response to:", "response to ", "response:"]
RESPONSE_PARAMETERS = "comment commentid reply replytocom response".split()
TITLE_SITE_SUFFIXES = [" - arxiv", " – arxiv", " — arxiv", " | arxiv", " (arxiv", " - pubmed", " – pubmed", " — pubmed", " | pubmed", " - pmc", " | pmc", " - springerlink", " | springerlink"]
TITLE_TAIL = "abstract acm arxiv digital html library neurips nips org paper pdf proceedings".split()
IDENTITY_STOP = "and current docs documentation example fix for from how official the use using with".split()
DISTINCTIVE_STOP = "and documentation example for full guideline guidelines how notes official release text the using what with".split()
CASE_STUDY_GENERIC = "adopt adopted adopting build builds case cases comparison comparisons experience guide guides hermetic journey large lessons migration migrated migrating monorepo monorepos polyglot postmortem postmortems reproducible reproducibility study studies system systems tool tools tradeoff tradeoffs".split()
LANGUAGE_REPOSITORIES = "dart go kotlin php-src python ruby rust scala swift typescript".split()
PATH_STOP = "current date latest news official recent".split()
PUBLIC_INFORMATION = "date dates deadline election license permit regulation regulations season voting".split()

# Numbers.
PERCENT_MEASURES = "apr growth inflation rate rates unemployment yield yields".split()
RELATIONS = {
    "rate rates apr interest": "rate rates apr apy interest",
    "inflation cpi": "inflation inflationary cpi price prices rose risen",
    "growth": "growth grew grown expanded",
    "unemployment": "unemployment jobless joblessness",
    "yield yields": "yield yields",
}
NUMERIC_TOPIC_STOP = "about and annual apr are average change changes cpi current did does for from growth how inflation interest latest monthly much now percent percentage price prices rate rates than that the their this today unemployment was were what when where which with year yield yields".split()

# URLs.
TRACKING = "fbclid gclid ref referrer source".split()
MULTI_PART_SUFFIXES = "ac.uk co.jp co.uk com.au com.br com.cn org.uk".split()
GENERIC_HOSTS = "github.com medium.com reddit.com stackoverflow.com wikipedia.org youtube.com".split()
SCHOLARLY_HOSTS = "aclanthology.org aclweb.org acm.org arxiv.org biorxiv.org cambridge.org cell.com core.ac.uk doi.org figshare.com frontiersin.org huggingface.co ieee.org jstor.org mdpi.com medrxiv.org nature.com ncbi.nlm.nih.gov neurips.cc nips.cc openreview.net osf.io oup.com paperswithcode.com plos.org researchsquare.com sagepub.com sciencedirect.com science.org semanticscholar.org springer.com tandfonline.com wiley.com zenodo.org".split()
RESEARCH_HOSTS = "ai.meta.com research.facebook.com research.google".split()

# Weights and limits.
POOL, SIDE_HITS, SIDE_POSITION = 32, 8, 4
EVIDENCE_WEIGHT, RECOMMENDATION_WEIGHT, CASE_STUDY_WEIGHT, GAP, EXACT_TITLE_BONUS = 0.04, 0.12, 0.10, 0.10, 0.20
CHUNK_TOKENS, OVERLAP_TOKENS, CHUNKS_SCORED, CHUNKS_TOTAL, CHUNKS_PER_DOCUMENT, LEXICAL_WEIGHT = 512, 64, 8, 24, 3, 0.10
NUMERIC_WEIGHT, NUMERIC_DOMAINS = 0.05, 3
DIVERSITY_GAP, DIVERSITY_TERMS, DIVERSITY_PERCENT = 0.04, 3, 60
SHINGLE_WORDS, LEAST_SHINGLES = 5, 40
#: (containment of the smaller set, of the larger) in percent: same site, equivalent subject, otherwise.
SAME_SITE, SAME_SUBJECT, OTHERWISE = (95, 82), (95, 80), (98, 95)
DECISIVE_SHARE, IDENTIFIER_SHARE = 0.40, 0.35
CACHE_SECONDS, DEGRADED_SECONDS, STALE_SECONDS, CACHE_ENTRIES, PAGE_BYTES = 600, 180, 3600, 256, 524_288
DEFAULT_RESULTS, MOST_RESULTS, DEFAULT_BUDGET, MOST_BUDGET = 8, 10, 24_000, 100_000

# Sites that a query names: all groups of a rule must occur among its tokens, "a|b" is either, "a+b" a phrase; the first rule counts.
DIAGNOSTIC_SITES = [
    ("postgres|postgresql", "postgresql.org"),
    ("rust", "doc.rust-lang.org"),
    ("aws", "docs.aws.amazon.com"),
    ("kubernetes", "kubernetes.io"),
    ("zod", "zod.dev"),
]
NAMED_SITES = [
    ("whatwg dom", "dom.spec.whatwg.org"),
    ("whatwg", "whatwg.org"),
    ("oss+security", "openwall.com"),
    ("nist", "nist.gov"),
    ("cdc", "cdc.gov"),
    ("copyright+office", "copyright.gov"),
    ("webauthn official|spec|specification|standard", "w3.org"),
    ("node lts|release|releases|schedule", "nodejs.org"),
    ("rust release|releases notes", "doc.rust-lang.org"),
    ("npm incident|incidents|status", "status.npmjs.org"),
    ("github docs|documentation|official", "docs.github.com"),
    ("aws docs|documentation|official", "docs.aws.amazon.com"),
    ("nvidia advisory|security|vulnerability", "nvidia.com"),
    ("federal+funds+rate", "federalreserve.gov"),
    ("geneva+convention|geneva+conventions", "icrc.org"),
    ("mortgage+rate|mortgage+rates data|official", "freddiemac.com"),
    ("cpi data|official", "bls.gov"),
    ("united+nations", "un.org"),
    ("acc aha guideline|guidelines", "jacc.org"),
    ("ada diabetes", "diabetesjournals.org"),
    ("postgresql docs|documentation|official|release|releases", "postgresql.org"),
    ("sqlite docs|documentation|official", "sqlite.org"),
    ("python docs|documentation|official", "docs.python.org"),
    ("react docs|documentation|official", "react.dev"),
]
SINGLE_WORD_SITES = {"fda": "fda.gov", "nasa": "nasa.gov", "nixos": "nixos.org", "tokio": "docs.rs", "arxiv": "arxiv.org"}

# More intent words, and phrases of an export service's outage pages.
QUESTION_ERRORS = "bug error exception failed failure fix mismatch panic undefined unresolved".split()
SOURCE_WORDS = "documentation docs guideline guidelines official".split()
DOCUMENTATION_WORDS = "documentation docs official".split()
AUTHORITY_DOCUMENTS = "advisory algorithm documentation docs guidance manual policy reference schedule spec specification standard status".split()
EXPLORATORY = "about latest new newest papers recent".split()
PAPER_MARKERS = "arxiv original paper papers pdf".split()
OUTAGES = ["the stackexchange server is too busy", "please try again later", "too many requests", "for the love it bears to fair maidens", "stackprinter - the stack exchange printer suite"]
