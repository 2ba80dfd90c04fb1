"""Enumerations, word lists, scores and patterns that results depend on."""

# Source tiers, from most to least authoritative, and numbers by tier.
TIERS = ("official_docs", "trusted_docs", "reference_examples", "community", "media", "unknown")
TIER_CONFIDENCE = {"official_docs": 0.92, "trusted_docs": 0.84, "reference_examples": 0.70, "community": 0.55, "media": 0.50, "unknown": 0.60}
TIER_AUTHORITY = {"official_docs": 25, "trusted_docs": 20, "reference_examples": 14, "community": 8, "media": 6, "unknown": 10}
TIER_ANSWER_WEIGHT = {"official_docs": 30, "trusted_docs": 22, "reference_examples": 12, "community": 4, "media": 2, "unknown": 6}
TIER_MEMORY_CONFIDENCE = {"official_docs": 0.90, "trusted_docs": 0.90, "reference_examples": 0.72, "community": 0.60, "media": 0.65, "unknown": 0.65}

# Points by tier and use case.
USE_CASES = ("api_facts", "comparison", "implementation_help", "tutorial", "general_research")
TIER_USE_CASE = {
    "official_docs": (100, 100, 100, 100, 100),
    "trusted_docs": (75, 75, 80, 80, 75),
    "reference_examples": (40, 35, 75, 75, 60),
    "community": (20, 15, 65, 60, 45),
    "media": (10, 10, 35, 50, 30),
    "unknown": (25, 25, 35, 35, 35),
}

# Domains by tier, in the order in which they are tried.
TIER_DOMAINS = {
    "official_docs": ["developers.facebook.com", "developers.google.com", "business-api.tiktok.com", "ads.tiktok.com", "platform.openai.com", "docs.anthropic.com", "docs.api.nvidia.com", "qdrant.tech", "supabase.com", "postgresql.org", "redis.io", "nextjs.org", "tanstack.com", "fastify.dev", "prisma.io", "github.com", "learn.microsoft.com"],
    "trusted_docs": ["support.google.com", "business.facebook.com", "docs.github.com"],
    "reference_examples": ["postman.com", "gitlab.com"],
    "community": ["stackoverflow.com", "reddit.com", "medium.com", "dev.to", "hashnode.dev", "quora.com"],
    "media": ["youtube.com", "youtu.be"],
}

# Query parameters that only track visitors.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "source"]

# Parts of links that a crawl doesn't follow.
UNFOLLOWED = ["/login", "/signin", "/signup", "/cart", "/checkout", "utm_", "mailto:"]

# Words that make a sentence look like a claim, and technical terms.
CLAIM_WORDS = [" is ", " are ", " uses ", " use ", " supports ", " provides ", " returns ", " requires ", " required ", " allows ", " includes ", " contains ", " must ", " should ", " can ", " cannot ", " endpoint", " api", " oauth", " authentication", " permission", " permissions", " rate limit", " quota", " pricing", " version", " deprec", " token", " access token", " scope", " field", " request", " response"]
TECH_TERMS = ["api", "sdk", "oauth", "token", "endpoint", "request", "response", "authenticate", "authorize", "permission", "scope", "credential", "key", "secret", "rate limit", "quota", "pricing", "version", "deprecated", "field", "schema", "parameter", "header", "body", "json", "xml", "rest", "graphql", "webhook"]

# Whole-word alternatives of query rules.
COMPARISON = "compare|comparison|vs|versus|difference|matrix"
API_FACTS = "api|endpoint|permission|oauth|quota|rate limit|field|pricing|docs|documentation"
IMPLEMENTATION = "error|bug|fix|workaround|not working|debug|issue"
TUTORIAL = "how to|tutorial|example|sample|guide"
CODE_QUERY = "github|repo|repository|sdk|client|library|implementation|readme|open source|oss|typescript|npm|pip|go get|install"
FRESH_QUERY = "latest|current|recent|today|now|new|updated|202[4-9]|version|changelog|release|pricing|rate limit|deprecated|deprecation"
FRESH_PLAN = "latest|current|today|recent|2025|2026|price|pricing|rate limit|version|changelog|news"
DEPRECATED = "deprecated|deprecation|legacy|obsolete|archived|sunset|retired"
MODE_COMPARISON = r"compare|comparison|versus|vs\.?|difference|differences|better|pros and cons|trade[\-\s]?off|tradeoff"
MODE_HOW_TO = "how to|implement|implementation|fix|debug|setup|set up|configure|install|integrate|deploy|error|issue|steps|guide"
MODE_SUMMARY = "overview|summarize|summary|explain|what is|research|tell me about|deep dive|analysis"

# Whole-word alternatives of page and section rules.
BLOCKED_PAGE = "access denied|blocked|403 forbidden|404 not found|sign in|log in|please enable javascript|this page requires javascript"
SECTION_BOOST_HIGH = "api|reference|authentication|authorization|permission|rate limit|quota|pricing|endpoint|request|response|field|schema"
SECTION_BOOST_LOW = "example|tutorial|faq|troubleshooting"
SECTION_API = "api|reference|authentication|authorization|endpoint|request|response|field|schema|parameter|property"
SECTION_GUIDE = "example|tutorial|guide|getting started|quickstart|overview|introduction"
SECTION_HELP = "faq|troubleshooting|common issues|errors|best practices"

# Search budgets by route: provider -> (most results, enabled).
ROUTE_BUDGETS = {
    "default": {"firecrawl": (6, True), "tavily": (10, True), "github": (8, True)},
    "docs": {"firecrawl": (6, True), "tavily": (8, True), "github": (3, False)},
    "freshness": {"firecrawl": (4, True), "tavily": (10, True), "github": (3, False)},
    "code": {"firecrawl": (4, True), "tavily": (6, True), "github": (10, True)},
}

# Whole-word alternatives of intents, in the order in which they are tried.
INTENT_KB = "readme|about.*project|tell me about|what.*codebase|documentation page"
INTENT_NEWS = "news|latest|current|today|recent|new update|breaking|announcement|announced|whatsapp|what'?s app"
INTENT_WEB = "api|sdk|docs?|documentation|oauth|auth|authentication|permission|rate limits?|integration|webhook|endpoint|compare|comparison|versus|vs"
INTENT_DOCUMENT = "uploaded|file|pdf|document|spreadsheet|csv|attachment|my doc|this doc"
REPO_QUERY = "github|repo|repository|code|sdk|client|package|library|implementation|example|readme|open source|oss"
INTENT_CODE = "write code|debug|fix code|implement|refactor|script|function|class|typescript|python|sql"

# Parts of questions that say what they need.
WANTS_TABLE = ["compare", "comparison", "table", "list"]
NEEDS_WEB = ["api", "docs", "documentation", "latest", "current", "meta", "facebook", "ads"]
COMPLEX_QUERY = ["compare", "research", "analyze", "should", "best", "architecture", "approach", "method", "strategy", "crawl", "url", "docs", "repo", "benchmark", "evaluate", "risk"]
STRATEGY_DOCUMENT = ["uploaded document", "this document", "my file", "uploaded file", "the file", "the document"]
STRATEGY_TABLE = ["compare", "comparison", " vs ", "versus", "difference"]
STRATEGY_SUMMARY = ["summarize", "summary", "overview", "key findings"]
CODING_TASK = ["code", "function", "bug", "debug", "typescript", "javascript", "python", "linked list", "leetcode", "algorithm", "complexity", "reverse", "implement"]
NEEDS_SOURCES = ["latest", "news", "docs", "api", "readme"]

# Answers that say nothing, and parts of raw or bad ones.
STOCK_ANSWERS = ["done", "completed", "all questions have been answered", "all questions have been answered.", "task complete", "the task is complete."]
PLACEHOLDERS = ["the comparison table", "the table above", "as shown above", "are provided above", "is provided above", "see above", "refer to the", "see the table"]
RAW_MARKERS = ["chunkId", "documentId", "sourceUrl", "retrieval", "metadata", "[{", "{'", "'chunkId'", "'sourceUrl'"]
GENERIC_PHRASES = ["not found in retrieved sources", "i don't have enough information", "i do not have enough information", "i cannot answer", "no relevant information", "unable to determine", "i'm sorry", "as an ai language model"]
EMPTY_FINALS = ["", "none", "null", "done", "all questions have been answered", "i have completed all tasks"]
WEAK_MENTIONS = ["youtube", "postman", "stackoverflow", "medium.com", "reddit.com"]
EMPTY_CELLS = ["| - |", "|—|", "| ?"]
DUMP_KEYS = ['"retrieval"', '"sources"', '"final"']

# First lines of answers by mode: where supported claims answer, and where only weak ones do.
INTROS = {
    "comparison": ("Here is the grounded comparison based on supported evidence.", "I found limited evidence, so treat this as a partial comparison."),
    "how_to": ("Here are the evidence-backed steps/details.", "I found limited evidence, so treat these as partial steps."),
    "research_summary": ("Here is the grounded research summary.", "I found limited evidence, so this is a partial research summary."),
    "general": ("Here is the grounded answer.", "I found only weak evidence, so treat this as a partial answer."),
}
THINGS_TO_VERIFY = ["- Check the linked official/trusted source before production use.", "- Treat weak evidence as a hint, not a final fact.", "- Re-run research with a narrower query if any required setup detail is missing."]

# Words that a search leaves out.
STOPWORDS = ["the", "and", "for", "with", "from", "this", "that", "into", "about", "using", "uploaded", "document", "file", "answer", "sources", "source", "summarize", "summary", "key", "points", "please", "what", "does", "tell", "give", "show"]

# Known documentation, all official: title, product, domain, address, topics, keywords, reason.
SOURCE_REGISTRY = [
    ("Meta Marketing API", "Meta Marketing API", "ads", "https://developers.facebook.com/docs/marketing-api/", ["ads", "api", "campaigns", "insights", "audiences"], ["meta", "facebook", "marketing api", "graph api", "ads api"], "Official Meta Marketing API documentation."),
    ("Google Ads API", "Google Ads API", "ads", "https://developers.google.com/google-ads/api/docs/start", ["ads", "api", "campaigns", "reporting"], ["google ads", "google ads api", "google advertising"], "Official Google Ads API documentation."),
    ("TikTok API for Business", "TikTok API for Business", "ads", "https://business-api.tiktok.com/portal/docs", ["ads", "api", "campaigns", "reporting"], ["tiktok", "tiktok ads", "tiktok business api"], "Official TikTok API for Business documentation."),
    ("OpenAI API Docs", "OpenAI API", "ai", "https://platform.openai.com/docs", ["ai", "llm", "api", "models"], ["openai", "gpt", "openai api", "chatgpt api"], "Official OpenAI API documentation."),
    ("Anthropic API Docs", "Anthropic Claude API", "ai", "https://docs.anthropic.com/", ["ai", "llm", "api", "claude"], ["anthropic", "claude", "claude api"], "Official Anthropic documentation."),
    ("NVIDIA AI Endpoints", "NVIDIA AI Endpoints", "ai", "https://docs.api.nvidia.com/", ["ai", "llm", "embedding", "api"], ["nvidia", "nvidia ai", "nvidia api", "nvidia embeddings"], "Official NVIDIA AI API documentation."),
    ("Qdrant Documentation", "Qdrant", "database", "https://qdrant.tech/documentation/", ["vector database", "retrieval", "search", "embeddings"], ["qdrant", "vector db", "vector database", "semantic search"], "Official Qdrant documentation."),
    ("Supabase Documentation", "Supabase", "database", "https://supabase.com/docs", ["postgres", "database", "auth", "storage"], ["supabase", "postgres", "supabase auth", "supabase database"], "Official Supabase documentation."),
    ("Prisma Documentation", "Prisma", "database", "https://www.prisma.io/docs", ["orm", "database", "postgres"], ["prisma", "orm", "prisma client", "prisma migrate"], "Official Prisma documentation."),
    ("Next.js Documentation", "Next.js", "web", "https://nextjs.org/docs", ["nextjs", "react", "frontend", "app router"], ["nextjs", "next.js", "react app router"], "Official Next.js documentation."),
    ("TanStack Query Documentation", "TanStack Query", "web", "https://tanstack.com/query/latest/docs/framework/react/overview", ["react", "query", "cache", "polling"], ["tanstack query", "react query", "polling", "cache"], "Official TanStack Query documentation."),
    ("Fastify Documentation", "Fastify", "backend", "https://fastify.dev/docs/latest/", ["backend", "node", "api", "server"], ["fastify", "node api", "fastify server"], "Official Fastify documentation."),
    ("Scrapling GitHub", "Scrapling", "scraping", "https://github.com/D4Vinci/Scrapling", ["scraping", "crawler", "html extraction"], ["scrapling", "scraper", "web scraping", "fetcher"], "Official Scrapling repository."),
    ("Microsoft MarkItDown", "MarkItDown", "document-processing", "https://github.com/microsoft/markitdown", ["document conversion", "markdown", "pdf", "docx"], ["markitdown", "pdf to markdown", "docx to markdown"], "Official MarkItDown repository."),
]
