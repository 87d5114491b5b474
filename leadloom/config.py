"""Settings of all operators. What must equal the reference's values for equal results stands here as text."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Word lists, patterns and limits.
ENGINES = ["mojeek", "duckduckgo", "yahoo", "bing"]
ENGINE_ALIASES = {"ddg": "duckduckgo"}
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_reader", "utm_name", "gclid", "fbclid", "msclkid", "mc_cid",
    "mc_eid", "ref", "referrer", "source", "yclid", "_ga", "igshid", "si", "feature", "app", "from",
]
AD_MARKS = ["bing.com/aclick", "google.com/aclk", "googleadservices.com", "doubleclick.net", "ad.doubleclick", "adservice.google"]
SUSPICIOUS_PATTERNS = [
    r"(results|search|query|find)\?",
    r"(?i)\.(pdf|docx?|xlsx?|zip|tar|pptx?)$",
    r"(?i)/jobs?/|/careers?/|/employment/",
    r"(?i)/press/|/news/|/blog/|/article/",
    r"(?i)/category/|/tag/|/topics?/",
    r"(?i)/(en|us|uk)/\d{4}/",
]
ALWAYS_EXCLUDED = [
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "tiktok.com", "youtube.com", "pinterest.com", "reddit.com", "quora.com",
    "tumblr.com", "snapchat.com", "threads.net", "whatsapp.com", "telegram.org", "discord.com", "twitch.tv", "vimeo.com", "dailymotion.com", "wikipedia.org",
    "wikimedia.org", "wikidata.org", "merriam-webster.com", "dictionary.com", "britannica.com", "cambridge.org", "play.google.com", "apps.apple.com",
    "maps.google.com", "google.com", "uservoice.com", "threebestrated.co.uk", "trovit.co.uk", "idobusiness.co.uk", "servicevista.co.uk",
]
DIRECTORY_DOMAINS = [
    "indeed.com", "indeed.co.uk", "glassdoor.com", "reed.co.uk", "totaljobs.com", "monster.com", "cv-library.co.uk", "ziprecruiter.com", "archinect.com",
    "dezeen.com", "clutch.co", "bark.com", "bark.co.uk", "expertise.com", "thumbtack.com", "angi.com", "angieslist.com", "homeadvisor.com", "homeguide.com",
    "porch.com", "houzz.com", "houzz.co.uk", "designerslisted.com", "designdirectory.co.uk", "checkatrade.com", "rated.people.co.uk", "freeindex.co.uk",
    "mybuilder.com", "ratedpeople.com", "trustpilot.com", "reviews.co.uk", "reviewsolicitors.co.uk", "feefo.com", "sitejabber.com", "bbb.org", "yell.com",
    "yelp.co.uk", "yelp.com", "zoopla.co.uk", "rightmove.co.uk", "onthemarket.com", "primelocation.com", "theagentfinder.co.uk", "allagents.co.uk",
    "ratemyagent.co.uk", "allthelettingagents.co.uk", "cylex-uk.co.uk", "brownbook.net", "hotfrog.co.uk", "yellowpages.com", "whitepages.com",
    "superpages.com", "manta.com", "chamberofcommerce.com", "businessfinder.com", "bizapedia.com", "dnb.com", "dunsguide.com", "companieshouse.gov.uk",
    "company-information.service.gov.uk", "opencorporates.com", "companies.io", "abclocaldirectory.com", "ultimatedir.biz", "franklinreport.com",
    "generalcontractors.org", "craigslist.org", "gumtree.com", "chaosads.com", "canetads.com", "locanto.com", "oodle.com", "bocadolobo.com", "luxxu.net",
    "roomdecorideas.eu", "livingroomideas.eu", "bestinteriordesigners.eu", "thespruce.com", "housebeautiful.com", "architecturaldigest.com", "elledecor.com",
    "veranda.com", "interiorzine.com", "archdaily.com", "designmilk.com", "zenwriting.net", "medium.com", "substack.com", "wordpress.com", "blogspot.com",
    "wix.com", "weebly.com", "squarespace.com", "ghost.io", "sites.google.com", "wikiexpression.com", "wikia.com", "fandom.com", "wikidot.com",
    "seowebstat.com", "statscrop.com", "websiteoutlook.com", "siteadvisor.com", "similarweb.com", "unipage.net", "educaedu.org", "coursesfinder.org",
    "coursera.org", "udemy.com", "skillshare.com", "upwork.com", "fiverr.com", "freelancer.com", "peopleperhour.com", "designhill.com", "99designs.com",
    "thebuildermarket.com", "hirerush.com", "peerspace.com", "decorilla.com", "havenly.com", "modsy.com",
]
EXCLUDED_DOMAINS = ["facebook.com", "linkedin.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "wikipedia.org", "tiktok.com"]
PARASITE_HOST = r"\.(com|co\.uk|org|net|io)\.[a-z]+\.(com|co\.uk|org|net|io)$"
LISTICLE = r"(top-\d|best-|guide-to|how-to|the-best|tips-for|vs\.|comparison)"
STOP_WORDS = [
    "the", "and", "for", "in", "of", "to", "a", "an", "with", "is", "are", "we", "our", "your", "that", "this", "it", "at", "on", "by",
]
NAME_SUFFIXES = [
    ".co.uk", ".org.uk", ".me.uk", ".net.uk", ".com", ".co", ".org", ".net", ".io", ".uk", ".ca", ".au", ".de", ".fr", ".es", ".it", ".nl", ".us", ".biz",
    ".info",
]
PLACEHOLDER_DOMAINS = [
    "domain.com", "email.com", "example.com", "example.org", "example.net", "doe.com", "test.com", "placeholder.com", "godaddy.com", "wix.com", "weebly.com",
    "squarespace.com", "wordpress.com", "mailinator.com", "yopmail.com", "tempmail.com", "guerrillamail.com", "sharklasers.com", "trashmail.com",
]
PLACEHOLDER_LOCALS = [
    "user", "username", "yourname", "your.name", "john", "jane", "firstname", "name", "test", "demo", "filler", "placeholder", "sample", "noreply", "email",
    "mail",
]
ASSET_EXTENSIONS = [".png", ".jpg", ".svg", ".gif", ".css", ".js"]
SKIP_EMAIL_KEYWORDS = [
    "noreply", "no-reply", "donotreply", "privacy", "dataprotection", "data-protection", "gdpr", "unsubscribe", "postmaster", "webmaster", "bounce",
    "complaints", "legal", "abuse", "spam", "newsletter",
]
GENERIC_EMAIL_KEYWORDS = [
    "info", "admin", "hello", "contact", "enquiries", "enquiry", "office", "mail", "email", "team", "support", "help", "sales", "accounts", "finance",
    "general", "service", "post",
]
PRIORITY_LOCALS = ["info", "hello", "contact", "enquiries", "enquiry"]
JUNK_EMAIL_DOMAINS = [
    "sentry.io", "wixpress.com", "example.com", "schema.org", "w3.org", "googleapis.com", "cloudflare.com", "jquery.com", "placeholder.com", "domain.com",
    "email.com", "doe.com", "test.com", "mailinator.com", "yopmail.com", "tempmail.com", "trashmail.com",
]
CONTACT_PATHS = ["/contact", "/contact-us", "/about", "/about-us"]
HAS_CONTACT = r"contact\s+us|enquir|get\s+in\s+touch|reach\s+us|call\s+us"
HAS_ABOUT = r"about\s+us|our\s+team|who\s+we\s+are|founded\s+in|established"
HAS_SERVICES = r"our\s+services|what\s+we\s+do|we\s+offer|we\s+provide|we\s+specialise"
IS_JOB_BOARD = r"job\s+description.{0,200}(salary|per\s+annum)|salary.{0,100}per\s+annum.{0,200}apply\s+now|\bvacancies\b.{0,200}\bapply\b.{0,200}\bsalary\b"
IS_DIRECTORY = r"showing\s+\d+\s+results|sort\s+by.{0,60}filter\s+by|\d+\s+businesses?\s+near|compare\s+quotes\s+from\s+\d+"
IS_NEWS = r"published\s+by\s+\w|leave\s+a\s+comment|related\s+articles|comments?\s+\(\d+\)"
TITLE_ENDING = (
    r"(?i)\s*[|\-–—·•]\s*(home|welcome|about|contact|services|solutions|official\s+site|homepage|main\s+page|index|default|"
    r"property\s+management|block\s+management|letting\s+agents?|estate\s+agents?).{0,60}$"
)
TITLE_TAIL = r"\s*[|\-–—]\s*.{1,60}$"
PHONE_PATTERNS = [
    r"\+\d{1,3}[\s\-\.]?\(?\d{1,4}\)?[\s\-\.]?\d{3,4}[\s\-\.]?\d{3,4}",
    r"\(\d{2,5}\)[\s\-\.]?\d{3,4}[\s\-\.]?\d{3,4}",
    r"\b\d{3,5}[\s\-\.]\d{3,4}[\s\-\.]\d{3,4}\b",
]
LOCALE_MARKS = [
    "/de/", "/de-de/", "/ja/", "/ja-jp/", "/sr/", "/sr-latn/", "/fr/", "/fr-fr/", "/es/", "/es-es/", "/it/", "/it-it/", "/nl/", "/pl/", "/pt/", "/ru/",
    "/tr/", "/ko/", "/zh/", "hl=de", "hl=ja", "lang=de", "locale=de", "language=de",
]
ENOUGH_RESULTS = {"mojeek": 10, "duckduckgo": 10, "yahoo": 7, "bing": 5}
#: The last page of results that engines show, by the largest offset that they take; others have no end.
MAX_PAGES = {"duckduckgo": 9, "yahoo": 10, "bing": 9}
LEAD_HEADERS = {
    "score": "Score", "company_name": "Company Name", "website_url": "Website URL", "domain": "Domain", "search_query": "Search Query",
    "search_engine": "Search Engine", "date_found": "Date Found", "flagged": "Flagged", "flag_reason": "Flag Reason",
}


@dataclass(frozen=True)
class LeadConfig:
    """What a user can set."""

    engines: list[str] = field(default_factory=lambda: list(ENGINES))
    excluded_exact: list[str] = field(default_factory=lambda: DIRECTORY_DOMAINS + ALWAYS_EXCLUDED)
    excluded_suffix: list[str] = field(default_factory=lambda: list(EXCLUDED_DOMAINS))
    keep_full_url: list[str] = field(default_factory=list)
    geo_suspect_tlds: list[str] = field(default_factory=list)
    boost_keywords: list[str] = field(default_factory=list)
    assess_on: str = "root"  # or "raw": the address before it is cut to the root
    skip_email_keywords: list[str] = field(default_factory=lambda: list(SKIP_EMAIL_KEYWORDS))
    generic_email_keywords: list[str] = field(default_factory=lambda: list(GENERIC_EMAIL_KEYWORDS))
    junk_email_domains: list[str] = field(default_factory=lambda: list(JUNK_EMAIL_DOMAINS))
    placeholder_domains: list[str] = field(default_factory=lambda: list(PLACEHOLDER_DOMAINS))
    contact_paths: list[str] = field(default_factory=lambda: list(CONTACT_PATHS))
    max_contact_paths: dict = field(default_factory=lambda: {"static": 4, "rendered": 2})
    max_pages: dict = field(default_factory=lambda: dict(MAX_PAGES))
    columns: dict = field(default_factory=dict)

    def merged(self, settings: dict) -> LeadConfig:
        """With settings laid over: dictionaries are merged one level deep, all else is replaced; unknown names are ignored (see load)."""
        own = {f.name: getattr(self, f.name) for f in fields(self)}
        return replace(self, **{k: own[k] | v if isinstance(own[k], dict) and isinstance(v, dict) else v for k, v in settings.items() if k in own})

    @classmethod
    def load(cls, path: str) -> LeadConfig:
        """The defaults with the settings of a JSON file laid over, or of a YAML one where yaml is installed. Unknown names raise ValueError."""
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            import yaml

            settings = yaml.safe_load(text) or {}
        else:
            settings = json.loads(text)
        if unknown := sorted(set(settings) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls().merged(settings)
