"""Rule tables. Users can replace any of them where a function takes the table as an argument."""

# Query parameters that only track.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "ref_id", "source", "trk", "trackingid", "gh_src", "lever-source", "ashby_jid", "utm", "from", "sp", "src"]

# Substrings of advertisement and tracker URLs.
AD_MARKS = ["/aclick?", "/aclick/", "bing.com/aclick", "googleadservices.com", "doubleclick.net", "adclick.", "/adclick?", "adservice.google", "ad.doubleclick", "syndicatedsearch.goog", "/pagead/", "clk.google"]

# Substrings by search tier; the first tier that has one decides, otherwise 4.
SEARCH_TIERS = {
    1: ["greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "smartrecruiters.com"],
    2: ["bayt.com", "gulftalent.com", "naukrigulf.com", "gulfjobs.com", "laimoon.com", "akhtaboot.com", "foundit.ae"],
    3: ["linkedin.com", "indeed.com", "glassdoor.com", "wellfound.com", "remoteok.com", "weworkremotely.com", "himalayas.app"],
}

# Substrings by source category; otherwise company_careers.
SOURCE_CATEGORIES = {
    "direct_ats": ["greenhouse", "lever.co", "ashbyhq", "workable", "smartrecruiters", "myworkday", "bamboohr", "breezy.hr", "jobvite"],
    "regional_board": ["naukrigulf", "bayt", "gulftalent", "gulfjobs", "dubizzle", "foundit", "akhtaboot", "laimoon", "tanqeeb", "mihnati"],
    "major_board": ["linkedin", "indeed", "glassdoor", "wellfound", "ziprecruiter", "monster"],
}

# Market source tiers with names.
MARKET_TIERS = [
    (1, "nseindia.com", "NSE India Official"), (1, "bseindia.com", "BSE India Official"), (1, "sebi.gov.in", "SEBI Regulatory Filing"),
    (1, "/investor-relations", "Official Company IR"), (1, "/ir/", "Official Company IR"), (1, "investor.", "Official Company IR"),
    (2, "moneycontrol.com", "Moneycontrol"), (2, "economictimes.indiatimes.com", "Economic Times"), (2, "livemint.com", "Mint"), (2, "business-standard.com", "Business Standard"),
    (2, "cnbctv18.com", "CNBC-TV18"), (2, "reuters.com", "Reuters"), (2, "bloomberg.com", "Bloomberg"), (2, "financialexpress.com", "Financial Express"),
    (2, "tradingview.com", "TradingView"), (2, "finance.yahoo.com", "Yahoo Finance"), (2, "screener.in", "Screener.in"), (2, "trendlyne.com", "Trendlyne"), (2, "tickertape.in", "TickerTape"),
    (3, "zerodha.com", "Financial Research / Broker Portal"), (3, "groww.in", "Financial Research / Broker Portal"), (3, "motilaloswal.com", "Financial Research / Broker Portal"),
    (3, "angelone.in", "Financial Research / Broker Portal"), (3, "icicidirect.com", "Financial Research / Broker Portal"), (3, "hdfcsec.com", "Financial Research / Broker Portal"),
    (3, "kotaksecurities.com", "Financial Research / Broker Portal"), (3, "investing.com", "Financial Research / Broker Portal"),
]

# Last path segments of listing pages, and substrings of application URLs to prefer or avoid.
BOARD_SEGMENTS = ["careers", "jobs", "openings", "vacancies", "all-jobs", "positions", "search", "browse"]
PREFERRED_APPLY = ["greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "smartrecruiters.com", "teamtailor.com", "personio", "myworkdayjobs.com", "icims.com", "oraclecloud.com", "successfactors.com", "ats.rippling.com"]
AGGREGATORS = ["indeed.com", "linkedin.com", "glassdoor.com", "bayt.com", "gulftalent.com", "naukrigulf.com", "monster.com", "ziprecruiter.com"]

# Local parts of role mailboxes.
ROLE_MAILBOXES = ["info", "support", "careers", "jobs", "hiring", "sales", "contact", "press", "hr", "hello", "team", "office", "media", "help", "inquiries", "recruiting", "recruitment", "talent", "people", "partnerships", "work", "apply"]

# Place aliases by cluster, in order of precedence.
GEO_ALIASES = {
    "saudi": ["saudi", "saudi arabia", "ksa", "riyadh", "jeddah", "dammam", "khobar", "dhahran", "neom", "mecca", "medina", "makkah", "jubail", "yanbu", "tabuk", "taif", "abha", "al khobar", "qassim", "hail", "jizan", "najran"],
    "uae": ["uae", "united arab emirates", "emirates", "dubai", "abu dhabi", "abu-dhabi", "sharjah", "ajman", "ras al khaimah", "fujairah", "umm al quwain", "al ain"],
    "egypt": ["egypt", "cairo", "alexandria", "giza"],
    "qatar": ["qatar", "doha"],
    "kuwait": ["kuwait", "kuwait city"],
    "bahrain": ["bahrain", "manama"],
    "oman": ["oman", "muscat"],
    "gcc": ["gcc", "gulf", "arabian gulf", "khaleej", "remote - gcc", "remote gcc"],
    "mena": ["mena", "middle east", "middle-east", "middle east and north africa", "near east", "remote - mena", "remote mena", "remote - middle east", "remote middle east"],
    "india": ["india", "bangalore", "bengaluru", "mumbai", "delhi", "new delhi", "hyderabad", "pune", "chennai", "gurgaon", "gurugram", "noida", "kolkata", "ahmedabad"],
    "uk": ["uk", "united kingdom", "britain", "england", "london", "manchester", "birmingham", "edinburgh", "glasgow", "scotland", "bristol", "cambridge", "oxford"],
    "us": ["us", "usa", "united states", "america", "san francisco", "new york", "seattle", "austin", "boston", "denver", "chicago", "california", "texas", "colorado", "washington", "los angeles", "san jose", "sunnyvale", "mountain view"],
    "eu": ["germany", "france", "netherlands", "ireland", "spain", "italy", "berlin", "paris", "amsterdam", "dublin", "europe"],
    "remote": ["remote", "worldwide", "global", "anywhere", "work from home", "wfh"],
}
REGIONS = {
    "gcc": ["saudi", "uae", "qatar", "kuwait", "bahrain", "oman", "gcc"],
    "mena": ["saudi", "uae", "qatar", "kuwait", "bahrain", "oman", "egypt", "gcc", "mena"],
}
GULF_HINTS = ["gulf", "gcc", "mena", "middle east", "arabian gulf", "gulf region", "gulf countries", "saudi", "ksa", "uae", "emirates", "qatar", "kuwait", "bahrain", "oman", "riyadh", "dubai", "abu dhabi", "doha", "sharjah", "jeddah"]

# Skill aliases by canonical name.
SKILL_ALIASES = {
    "langchain": ["langchain", "lang chain", "lang-chain"],
    "langgraph": ["langgraph", "lang graph", "lang-graph"],
    "llm": ["llm", "llms", "large language model", "large language models", "foundation model", "foundation models"],
    "rag": ["rag", "rags", "retrieval augmented generation", "retrieval-augmented generation"],
    "pytorch": ["pytorch", "torch", "py torch", "py-torch"],
    "kubernetes": ["kubernetes", "k8s", "kube"],
    "docker": ["docker", "containerization"],
    "python": ["python", "python3", "python 3", "python programming", "python development", "python developer"],
    "genai": ["genai", "gen ai", "generative ai", "generative-ai"],
    "azure": ["azure", "microsoft azure"],
    "aws": ["aws", "amazon web services"],
    "gcp": ["gcp", "google cloud", "google cloud platform"],
    "sql": ["sql", "mysql", "postgresql", "postgres"],
    "react": ["react", "reactjs", "react.js"],
}

# Job families that a request for an engineering title excludes.
OTHER_FAMILIES = {
    "product_management": ["product manager", "product owner", "technical product manager", "product lead", "head of product", "vp product", "director of product"],
    "sales_marketing": ["sales manager", "sales executive", "sales representative", "account executive", "business development", "bdr", "sdr", "sales specialist", "marketing manager", "marketing specialist", "growth specialist", "seo specialist"],
    "business_analysis": ["business analyst", "bi analyst", "operations analyst", "strategy analyst", "financial analyst"],
    "content_writing": ["content writer", "copywriter", "technical writer", "content creator", "editor", "content strategist"],
    "human_resources": ["recruiter", "talent acquisition", "human resources", "hr manager", "people operations", "people partner"],
    "qa_testing": ["qa engineer", "quality assurance", "test automation", "software tester", "manual tester", "sdit"],
    "support_it": ["service desk", "desktop support", "it support", "help desk", "system administrator", "sysadmin"],
    "cybersecurity": ["cybersecurity", "cyber security", "infosec", "soc analyst", "penetration tester", "security analyst"],
    "finance_accounting": ["accountant", "auditor", "finance manager", "bookkeeper"],
    "full_stack": ["full stack", "fullstack", "frontend", "front end", "web developer"],
}
TECH_MARKS = ["engineer", "developer", "architect", "programmer", "scientist", "applied ai", "ml", "genai", "generative ai", "consultant"]
GENAI_TERMS = ["genai", "gen ai", "generative ai", "generative-ai", "llm", "large language model", "large language models", "foundation model", "foundation models", "prompt engineer", "prompt engineering", "rag engineer", "agentic", "ai agent", "ai agents", "llmops", "llm ops", "llm engineer", "llm developer", "llm researcher"]
AI_TERMS = ["applied ai", "ai engineer", "artificial intelligence engineer", "ai platform engineer", "ai developer", "ai software engineer", "ai solutions engineer", "ai solutions architect", "ai architect", "ai consultant", "artificial intelligence consultant", "generative ai consultant", "ai technical lead", "ai lead", "head of ai", "director of ai", "ai specialist", "ai application developer", "ai infrastructure engineer", "ai systems engineer", "ai research engineer", "ai scientist", "ai researcher", "ai research scientist"]
ML_TERMS = ["machine learning engineer", "ml engineer", "software engineer - ai", "deep learning engineer", "nlp engineer", "natural language processing", "computer vision engineer", "ml platform engineer", "mlops engineer", "applied scientist", "research scientist - ai", "ai researcher", "ml researcher", "nlp researcher", "ml scientist", "applied machine learning"]
ROLE_NOUNS = ["engineer", "developer", "architect", "programmer", "scientist", "consultant", "specialist", "researcher"]

# Listing-page marks in titles.
TITLE_BANNERS = ["local employers hiring", "make your job hunting simpler", "local employers", "hiring on indeed", "hiring in dubai", "search results", "browse jobs", "view all jobs"]

# Freshness limits in seconds (fresh, aging, stale) by kind.
FRESHNESS = {
    "market_price": (1800, 86400, 172800), "market_news": (86400, 259200, 604800), "job_posting": (1209600, 2592000, 5184000),
    "company_profile": (15552000, 31536000, 63072000), "annual_report": (31536000, 63072000, 94608000), "default": (604800, 2592000, 7776000),
}

# Risk signatures.
RISKS = [
    ("regulatory_probe", "HIGH", r"\b(?:sebi|sec|investigation|probe|regulatory action|show cause notice|penalty imposed|audit qualification)\b"),
    ("promoter_pledge", "HIGH", r"\b(?:promoter pledge|pledged shares|high pledge|margin call)\b"),
    ("debt_burden", "MEDIUM", r"\b(?:high debt|debt overhang|default on payment|liquidity crunch|debt-to-equity ratio exceeds)\b"),
    ("earnings_downgrade", "MEDIUM", r"\b(?:earnings miss|target price cut|downgrade|rating cut|margin contraction|weak guidance)\b"),
    ("corporate_restructuring", "MEDIUM", r"\b(?:layoffs|workforce reduction|job cuts|hiring freeze|restructuring|management exit)\b"),
]

# Signals of pages that are no posting.
ERROR_SIGNALS = ["404 not found", "page not found", "error 404", "access denied", "attention required! | cloudflare", "enable javascript", "please sign in", "log in to continue", "login to view", "session expired"]
EXPIRED_SIGNALS = ["this job has expired", "job is no longer available", "this position has been closed", "position has been filled", "applications are now closed", "no longer accepting applications", "this listing has expired", "the job you are looking for is no longer open", "this job is no longer accepting applications"]
POSTING_SIGNALS = ["responsibilities", "requirements", "qualifications", "about the role", "who you are", "what you'll do", "what you will do", "apply now", "submit application", "apply for this job", "apply for this role", "compensation", "salary", "benefits", "years of experience"]
