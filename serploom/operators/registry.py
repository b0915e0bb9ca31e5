"""The factor dimension: one row per factor, in registry order (the last key of every tie)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Id; display name; source; group; phase; unit; flags (T200 = strongest tier, bool, hard = difficult, less = less is better,
# nonlin = nonlinear). EMAIL etc. read as they are.
FACTORS = """
TITLE_LEN; Title Length; html; Title; Title & Headings; Characters;
TITLE_WORDS; Title Word Count; html; Title; Title & Headings; Words;
TITLE_VARS; Variations in Title Tag; html; Title; Title & Headings; Variations; T200
TITLE_LEAD_VARS; Leading Variations in Title Tag; html; Title; Title & Headings; Variations; bool
TITLE_HAS_DOMAIN; Has Domain In Title; html; Title; Title & Headings; Boolean; bool
OG_TITLE_VARS; Variations in OpenGraph Title; html; Title; Title & Headings; Variations;
HEADING_COUNT; Number of Heading Tags; html; Headings; Title & Headings; Tags; T200
H1_COUNT; Number of H1 Tags; html; Headings; Title & Headings; Tags;
H1_VARS; Variations in H1 Tags; html; Headings; Title & Headings; Variations; T200
H2_VARS; Variations in H2 Tags; html; Headings; Title & Headings; Variations; T200
H3_VARS; Variations in H3 Tags; html; Headings; Title & Headings; Variations; T200
H1H6_VARS; Variations in H1-H6 Tags; html; Headings; Title & Headings; Variations; T200
H1H3_VARS; Variations in H1, H2, and H3 Tags; html; Headings; Title & Headings; Variations; T200
LEAD_VARS_H1H6; Leading Variations in H1-H6 Tags; html; Headings; Title & Headings; Variations; T200
EXACT_H1H6; Exact Matches in H1-H6 Tags; html; Headings; Title & Headings; Exact Matches; T200
QUESTIONS_H1; Number of Questions in H1 Tags; html; Headings; Title & Headings; Count;
WORD_COUNT; Word Count; html; Content; Content; Words; T200
UNABRIDGED_WORD_COUNT; Unabridged Word Count; html; Content; Content; Words; T200
CLEAN_TEXT_KB; Clean Text Kilobytes; html; Content; Content; Other; T200
PAGE_SIZE_KB; Page Size Kilobytes; html; Content; Content; Other; T200
SENTENCES; Number of Sentences; html; Content; Content; Sentences; T200
AVG_WORDS_SENTENCE; Average Words Per Sentence; html; Content; Content; Words;
P_TAGS; Number of P Tags; html; Content; Content; Tags; T200
HTML_TAGS; Number of HTML Tags; html; Content; Content; Tags; T200
BODY_VARS; Variations in Body Tags; html; Content; Content; Variations; T200
HTML_VARS; Variations in HTML Tags; html; Content; Content; Variations; T200
P_VARS; Variations in P Tags; html; Content; Content; Variations; T200
EXACT_HTML; Exact Matches in the HTML Tag; html; Content; Content; Exact Matches; T200
VAR_DENSITY_30KB; Variation Density in Top 30KB; html; Content; Content; Percent; T200 hard
CLEAN_KW_DENSITY; Clean Keyword Density; html; Content; Content; Percent; T200 hard
TF; Term Frequency; corpus; Content; Content; Other; T200
TFIDF; TF/IDF; corpus; Content; Content; Other;
FLESCH_EASE; Flesch Kincaid Reading Ease; html; Content; Content; Other; nonlin
FLESCH_GRADE; Flesch Kincaid Grade Level; html; Content; Content; Other; nonlin
BYTES_TO_FIRST_MATCH; Number of Bytes to First Match; html; Content; Content; Other; less
UNIQUE_VARS; Number of Unique Variations Used; html; Diversity; Diversity; Variations; T200 hard
LSI_SENTENCES; LSI Words in Sentences; corpus; Diversity; Diversity; LSI; T200
UNIQUE_LSI; Number of Unique LSI Words Used; corpus; Diversity; Diversity; LSI; T200 hard
SR_DOMAIN_COM; Search Result Domain is .com/.net/.org; serp; SERP Presentation; Search Result Presentation; Boolean; bool hard
SR_DOMAIN_HYPHEN; Search Result Domain Has Hyphen; serp; SERP Presentation; Search Result Presentation; Boolean; bool hard less
SR_DOMAIN_LEN; Search Result Domain Length; serp; SERP Presentation; Search Result Presentation; Characters; hard
SR_URL_HAS_YEAR; Search Result URL has Year; serp; SERP Presentation; Search Result Presentation; Boolean; bool hard
SR_SUMMARY_LEN; Search Result Summary Length; serp; SERP Presentation; Search Result Presentation; Characters; hard
SR_TITLE_VARS; Variations in Search Result Link Text; serp; SERP Presentation; Search Result Presentation; Variations; T200 hard
SR_URL_VARS; Variations in Search Result Display URL; serp; SERP Presentation; Search Result Presentation; Variations; T200 hard
SR_SUMMARY_VARS; Variations in Search Result Summary; serp; SERP Presentation; Search Result Presentation; Variations; T200 hard
LINKS; Number of Links (Content); html; Links; Outbound Links; Count; T200 hard
INTERNAL_LINKS; Number of Internal Links (Content); html; Links; Outbound Links; Count; T200
EXTERNAL_LINKS; Number of External Links (Content); html; Links; Outbound Links; Count;
HTTPS_LINKS; Number of HTTPS Links (Content); html; Links; Outbound Links; Count; T200 hard
DOFOLLOW_EXT_LINKS; Number of DoFollow External Links (Content); html; Links; Outbound Links; Count; hard
NOFOLLOW_LINKS; Number of NoFollow External Links (Content); html; Links; Outbound Links; Count; hard
A_VARS; Variations in A Tags; html; Links; Outbound Links; Variations; T200
SOCIAL_LINKS; Number of Social Pages; html; Links; Social Integration; Count;
IMAGES; Number of Images; html; Images; Images; Count; T200
IMAGES_ALT; Number of Images with ALT Text; html; Images; Images; Count; T200
ALT_VARS; Variations in ALT Attributes; html; Images; Images; Variations; T200
HAS_JSONLD; Has JSON-LD Schema Markup; html; Schema; Schema; Boolean; T200 bool hard
SCHEMA_TYPES; Number of Schema Types; html; Schema; Schema; Count; hard
USES_ORG_LOCALBIZ; Uses Organization/LocalBusiness Schema; html; Schema; Schema; Boolean; bool hard
USES_PRODUCT_OFFER; Uses Product/Offer Schema; html; Schema; Schema; Boolean; bool hard
USES_AGG_RATING; Uses AggregateRating Schema; html; Schema; Schema; Boolean; bool hard
USES_FAQ; Uses FAQ/Question Schema; html; Schema; Schema; Boolean; bool hard
USES_BREADCRUMB; Uses BreadcrumbList Schema; html; Schema; Schema; Boolean; bool hard
CLAIMED_BRANDS; Number of Claimed Brands (sameAs); html; Schema; Schema; Count; hard
META_DESC_LEN; Meta Description Length; html; Technical; Technical; Characters;
META_DESC_WORDS; Word Count in Meta Description; html; Technical; Technical; Words;
META_DESC_VARS; Variations in Meta Description; html; Technical; Technical; Variations;
META_KEYWORDS; Number of Meta Keywords; html; Technical; Technical; Count;
HAS_DOCTYPE; Has DocType Tag; html; Technical; Technical; Boolean; bool
HAS_FORM; Has Form; html; Technical; Technical; Boolean; bool
HAS_VIDEO; Has Video or YouTube Embed; html; Technical; Technical; Boolean; bool
HAS_PRIVACY; Has Privacy Policy; html; Technical; Technical; Boolean; bool
HAS_EMAIL; Has Email; html; Technical; Technical; Boolean; bool
LOAD_MS; Load Time Milliseconds; html; Technical; Technical; Other; less
REF_DOMAINS; Number of Referring Domains; backlinks; Authority; Authority; Count; hard
BACKLINKS; Number of Backlinks; backlinks; Authority; Authority; Count; hard
AUTHORITY_SCORE; Domain Authority Score; backlinks; Authority; Authority; Other; hard
PAGE_AUTHORITY; Page Authority Score; backlinks; Authority; Authority; Other; T200 hard
PAGE_REF_DOMAINS; Referring Domains to Page; backlinks; Authority; Authority; Count; T200 hard
PAGE_BACKLINKS; Backlinks to Page; backlinks; Authority; Authority; Count; hard
PAGE_FOLLOW_RATIO; Page DoFollow Backlink Ratio; backlinks; Authority; Authority; Percent; hard
HOMEPAGE_AUTHORITY; Homepage Authority Score; backlinks; Authority; Authority; Other; hard
BRAND_VOLUME; Branded Search Volume; backlinks; Brand; Brand; Count; hard
ENTITIES_TITLE; Entities in Title Tag; entity; Entity; Entities; Entities; T200
ENTITIES_H1; Entities in H1 Tags; entity; Entity; Entities; Entities; T200
ENTITIES_H2; Entities in H2 Tags; entity; Entity; Entities; Entities; T200
ENTITIES_H3; Entities in H3 Tags; entity; Entity; Entities; Entities;
ENTITIES_BODY; Entities in the HTML Tag; entity; Entity; Entities; Entities; T200
ENTITIES_SENTENCES; Entities in Sentences; entity; Entity; Entities; Entities; T200
DISTINCT_ENTITIES; Number of Distinct Entities Used; entity; Entity; Entities; Entities; T200
ENTITY_SALIENCE_SUM; Total Entity Salience; entity; Entity; Entities; Other;
EAV_COMPLETENESS; Topical EAV Completeness; entity; Entity; Entities; Percent; T200
SALIENT_TERM_COVERAGE; Salient Term Coverage; semantic; Semantic; Content; Percent; T200
BEST_PASSAGE_SIM; Best Passage Relevance; semantic; Semantic; Content; Percent; T200
SUBINTENT_COVERAGE; Sub-Intent Coverage; semantic; Semantic; Content; Percent; T200
CONTENT_FOCUS; Content Focus; semantic; Semantic; Content; Percent;
CONTENT_EFFORT; Content Effort; quality; Quality; Trust & Experience; Percent; T200 hard
HELPFULNESS; Helpfulness; quality; Quality; Trust & Experience; Percent; hard
TRUST_BYLINE; Has Author Byline; trust; Trust; Trust & Experience; Boolean; bool
TRUST_AUTHOR_PAGE; Links to an Author Page; trust; Trust; Trust & Experience; Boolean; bool
TRUST_PERSON_SCHEMA; Person Schema; trust; Trust; Trust & Experience; Boolean; bool
TRUST_ORG_SCHEMA; Organization Schema; trust; Trust; Trust & Experience; Boolean; bool
TRUST_SAMEAS; sameAs Profile Links; trust; Trust; Trust & Experience; Count;
TRUST_OUTBOUND_CITATIONS; Outbound Citations; trust; Trust; Trust & Experience; Count;
TRUST_CONTACT_LINK; Contact/About Reachable; trust; Trust; Trust & Experience; Boolean; bool
TRUST_VISIBLE_DATE; Visible Publish/Update Date; trust; Trust; Trust & Experience; Boolean; bool
CRUX_LCP_MS; CrUX LCP (p75, ms); crux; Experience; Technical; Other; less
CRUX_INP_MS; CrUX INP (p75, ms); crux; Experience; Technical; Other; less
CRUX_CLS; CrUX CLS (p75, x100); crux; Experience; Technical; Other; less
CRUX_HAS_DATA; In Chrome UX Report; crux; Experience; Technical; Boolean; bool
CLICK_SHARE; Simulated SERP Click Share; engagement; Engagement; Search Result Presentation; Percent; T200
SATISFACTION; Post-Click Satisfaction; engagement; Engagement; Search Result Presentation; Percent; hard
"""

# Roadmap phases in their order.
PHASES = [
    "Title & Headings", "Content", "Entities", "Diversity", "Schema", "Images", "Outbound Links", "Social Integration", "Technical",
    "Search Result Presentation", "Trust & Experience", "Authority", "Brand",
]
IMPORTANT_GROUPS = ["Entity", "Authority", "Brand"]


@dataclass(frozen=True)
class Factor:
    id: str
    source: str
    group: str
    phase: str
    unit: str
    top200: bool
    is_bool: bool
    difficulty: str
    direction: str
    ordinal: int
    label: str = ""

    @property
    def name(self) -> str:
        """The display name; of a factor registered without one, made from its id."""
        return self.label or self.id.replace("_", " ").capitalize()


def _read(text: str) -> list[Factor]:
    out = []
    for n, line in enumerate(text.strip().splitlines()):
        id_, label, source, group, phase, unit, flags = (x.strip() for x in line.split(";"))
        f = set(flags.split())
        direction = "less_is_better" if "less" in f else "nonlinear" if "nonlin" in f else "more_is_better"
        out.append(Factor(id_, source, group, phase, unit, "T200" in f, "bool" in f, "Difficult" if "hard" in f else "Easy", direction, n, label))
    return out


REGISTRY = _read(FACTORS)
BY_ID = {f.id: f for f in REGISTRY}


def register(factor: Factor) -> None:
    """Add a factor of your own; its column goes into factors.HTML or comes in as rows of the long table."""
    if factor.id in BY_ID:
        raise ValueError(f"{factor.id} is registered")
    REGISTRY.append(factor)
    BY_ID[factor.id] = factor


def factor_def(spark: SparkSession) -> DataFrame:
    """The dimension as a table; a hundred rows, broadcast by size."""
    rows = [(f.id, f.name, f.source, f.group, f.phase, f.unit, f.top200, f.is_bool, f.difficulty, f.direction, f.ordinal, PHASES.index(f.phase) if f.phase in PHASES else len(PHASES)) for f in REGISTRY]
    return spark.createDataFrame(rows, "factor_id string, name string, source string, `group` string, phase string, unit string, top200 boolean, is_bool boolean, difficulty string, direction string, ordinal int, phase_order int")
