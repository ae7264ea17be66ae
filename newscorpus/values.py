"""Word lists, lookup rows, tag sets and defaults.

Each one is only the default of a parameter, so another site or language passes its own.
Site names (base URL, output prefix, default byline and title) are neutral on purpose.
"""

# Section key, native name, English name, path.
SECTIONS = [
    ("politics", "રાજકારણ", "Politics", "/category/politics/"),
    ("world", "દુનિયા", "World", "/category/world/"),
    ("crime", "ક્રાઈમ", "Crime", "/category/crime/"),
    ("reports", "ન્યૂઝ રિપોર્ટ", "Reports", "/category/reports/"),
    ("gujarat", "ગુજરાત", "Gujarat", "/category/gujarat/"),
    ("explainer", "એક્સપ્લેઇનર", "Explainer", "/category/explainer/"),
    ("india", "દેશ", "India", "/category/india/"),
    ("factcheck", "ફેક્ટ-ચેક", "FactCheck", "/category/fact-check/"),
    ("media", "મિડિયા", "Media", "/category/media/"),
    ("religion", "ધર્મ/સંસ્કૃતિ", "Religion", "/category/misc/religion-and-culture/"),
    ("entertainment", "મનોરંજન", "Entertainment", "/category/misc/entertainment/"),
    ("sports", "સ્પોર્ટ્સ", "Sports", "/category/misc/sports/"),
    ("satire", "કટાક્ષ", "Satire", "/category/misc/satire/"),
    ("misc", "વગેરે", "Miscellaneous", "/category/misc/"),
]

# The section of a demo run and its page cap.
DEMO_SECTION = "gujarat"
DEMO_MAX_PAGES = 2

# Words that mark a menu, banner or advertisement block when cleaning.
CLEAN_BLOCKLIST = [
    "હોમપેજ", "દેશ", "રાજકારણ", "એક્સપ્લેઇનર", "ધર્મ", "સંસ્કૃતિ", "વિશેષ",
    "સંપાદકની પસંદ", "મંતવ્ય", "ગુજરાત", "દુનિયા", "Advertisement", "जाहरात",
    "જાહેરાત", "Photo:",
]

# Words that drop a block when laying an article out.
LAYOUT_BLOCKLIST = ["- Advertisement -", "જાહેરાત", "जाहरात", "Photo:", "Source:"]

# Block elements of the two passes, and which of them are headings. A span is no
# block: its text belongs to the block around it, or stands loose outside of any.
CLEAN_TAGS = ["p", "h1", "h2", "h3", "div"]
CLEAN_HEADINGS = ["h1", "h2", "h3"]
LAYOUT_TAGS = ["p", "h2", "h3", "h4"]
LAYOUT_HEADINGS = ["h2", "h3", "h4"]

# Block-level elements: any of their tags ends the block before it.
BLOCK_LEVEL = [
    "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main",
    "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
]

# Block-level elements that others lie in and whose closing tag may not be left out.
CONTAINERS = [
    "article", "aside", "blockquote", "body", "div", "dl", "figure", "footer", "form", "header",
    "main", "nav", "ol", "section", "table", "ul",
]

# Marks that end sentences and clauses, in several scripts.
SENTENCE_MARKS = ".!?;:,…।॥。、，！？；："

# Elements that never hold article text.
DROP_TAGS = ["script", "style", "nav", "footer", "head"]

# Class names of page furniture and of the containers that hold content.
CHROME_CLASSES = ["td-header-menu-wrap", "td-header-sp-container", "td-mobile-nav"]
LISTING_CLASSES = ["td-main-content-wrap"]
CONTENT_CLASSES = ["td-post-content", "entry-content", "article-body", "td-ss-main-content"]
AUTHOR_CLASSES = ["td-post-author-name", "author"]
DATE_CLASSES = ["td-post-date", "entry-date"]
FOOTER_CLASS = "metadata_footer"

# Retry and paging rules of the fetch log.
MAX_CONSECUTIVE_ERRORS = 3
MAX_RETRIES = 3
RETRY_DELAY_SECONDS = 2.0
RETRY_BACKOFF = 1.5

# Fixed value: an author is accepted only below this many characters.
AUTHOR_LIMIT = 50

BASE_URL = "https://news.example.org"
OUTPUT_PREFIX = "News_Archive"
ARCHIVE_TITLE = "News Archive"
DEFAULT_TITLE = "આર્કાઇવ લેખ"
DEFAULT_AUTHOR = "સ્ટાફ"
# Fixed value.
DEFAULT_DATE = "June 2026"

# Labels of a cover, and of the header of a rendered page.
COVER_SECTION = "Category: "
COVER_MONTH = "Month: "
COVER_COUNT = "Total Articles: "
COVER_STAMP = "Archived on: "
HEADER_TITLE = "Article Title: "
HEADER_AUTHOR = "Author"
HEADER_DATE = "Date"
