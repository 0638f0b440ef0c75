"""Explicit schemas as DDL text. Nothing in the library relies on inference."""

# One Atom entry as the XML reader sees it: attributes carry "_", element text is "_VALUE".
ENTRY = (
    """
    title struct<_VALUE string, _type string>,
    link array<struct<_VALUE string, _rel string, _href string>>,
    published string,
    author array<struct<name string, n string>>,
    source struct<title struct<_VALUE string, _type string>,
                  link array<struct<_VALUE string, _rel string, _href string>>>,
    summary struct<_VALUE string, _type string>,
    content struct<_VALUE string, _type string>,
    `media:content` array<struct<_VALUE string, _medium string, _url string>>,
    `media:group` struct<`media:content` array<struct<_VALUE string, _medium string, _url string>>>,
    _corrupt_record string
    """
)

IMAGE_DDL = "struct<src string, alt string, width string, height string>"

FEATURES_DDL = (
    "struct<length bigint, word_count bigint, has_code boolean, has_quotes bigint, quote_count bigint, "
    "sentence_count bigint, link_count bigint, reading_time bigint, technical_terms bigint, "
    f"images array<{IMAGE_DDL}>, summary string, paywall_detected boolean, main_image string>"
)

# One article. Row order is data: (feed_ord, entry_ord) is unique.
ARTICLE = (
    "article_id string, feed_ord bigint, entry_ord bigint, title string, url string, domain string, "
    "image_url string, author string, source string, summary string, read_more_url string, "
    "published string, published_ts timestamp, full_text string, content string, "
    "processed_content string, category string, category_score double, "
    "category_scores map<string, bigint>, subcategory string, reading_time bigint, entities string, "
    f"is_paywalled boolean, status string, features {FEATURES_DDL}"
)

# A model response stored as text.
RESPONSE = (
    "category string, subcategory string, formatted_markdown string, confidence string"
)

CACHE_COLUMNS = ("url", "content", "features", "cached_at")
CACHE = "url string, content string, features string, cached_at timestamp"

# One digest line. Sorting by every column but the last gives the document order.
DIGEST_ORDER = ("issue", "kind", "part", "section_ord", "section", "sub_ord", "subsection",
                "feed_ord", "entry_ord", "line_ord")
