"""Column functions over text, ids and binary values. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats, limits and lists that results must agree with.
POINT_NAMESPACE = "6f9619ff8b86d011b42d00c04fc964ff"
IMAGE_SCHEME = "rag-image"
IMAGE_REF = r"!\[([^\]]*)\]\(([^)\s]+)\)"
TEMPLATE_TITLES = ("ethan frome", "document", "document1", "untitled", "microsoft word", "presentation1", "book1", "classeur1")
TEMPLATE_PREFIXES = ("microsoft word", "untitled", "document")
MIME_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp"}
DECORATIVE_PHRASES = (
    "il n'y a pas d'interface logicielle visible",
    "aucune action spécifique n'est illustrée",
    "aucune action spécifique (clic",
    "il s'agit d'un visuel statique",
    "l'image est purement illustrative",
    "l'image semble être une simple représentation graphique",
    "l'image est une simple représentation graphique",
    "purement illustrative et ne montre aucune action",
    "ne montre aucune action spécifique",
    "montre le logo de",
    "présente le logo de",
    "présente le logotype",
    "image de marque",
    "présente un visuel promotionnel",
    "visuel promotionnel ou informatif",
    "visuel statique",
    "page de remerciement",
    "page de conclusion",
    "diapositive de remerciement",
    "diapositive de conclusion",
    "diapositive de titre",
    "diapositive d'introduction",
    "slide de titre",
    "page de garde",
    "page de couverture",
    "présente une diapositive de présentation intitulée",
    "illustration vectorielle représentant",
    "illustration vectorielle stylisée",
    "scène industrielle stylisée",
    "fond décoratif",
    "présente une vignette graphique",
    "aucun logiciel, interface",
    "il n'y a aucun texte lisible",
    "aucun texte n'est visible",
    "aucun texte lisible",
    "aucun élément textuel",
    "ne contient aucun texte",
    "il s'agit d'un élément graphique",
    "élément graphique abstrait",
    "élément décoratif",
    "forme géométrique",
    "trait diagonal",
    "barre oblique",
    "ligne diagonale verte",
    "présente un fond blanc",
    "image quasi vide",
    "image principalement blanche",
    "image presque entièrement blanche",
    "espace vide avec",
    "fond blanc avec une simple",
    "fond blanc avec un",
    "fond blanc traversé",
    "un simple trait",
    "une simple forme",
)
TOKEN = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9_]+"
STOPWORDS_FR = (
    "le", "la", "les", "un", "une", "des", "de", "du", "au", "aux",
    "et", "ou", "mais", "donc", "or", "ni", "car", "que", "qui", "quoi",
    "où", "comment", "quand", "pourquoi", "est", "sont", "a", "ai", "as",
    "avoir", "être", "fait", "faire", "pour", "par", "avec", "sans",
    "dans", "sur", "sous", "ce", "cette", "ces", "cet", "mon", "ma", "mes",
    "ton", "ta", "tes", "son", "sa", "ses", "il", "elle", "on", "nous",
    "vous", "ils", "elles", "je", "tu", "me", "te", "se", "y", "en",
    "à", "aussi", "si", "non", "oui", "pas", "plus", "ne", "là",
)
STOPWORDS_EN = (
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "of", "in", "on", "at", "to", "for", "with", "from", "by", "about",
    "as", "into", "through", "during", "before", "after", "above", "below",
    "this", "that", "these", "those", "i", "you", "he", "she", "it", "we",
    "they", "what", "which", "who", "whom", "whose", "when", "where", "why",
    "how", "not", "no", "so",
)
VIDEO_ID = r"(?i)(?:youtube\.com/watch\?(?:[^#\s]*&)?v=|youtu\.be/|youtube\.com/shorts/|youtube\.com/embed/)([A-Za-z0-9_-]{11})"
STOPWORDS = tuple(dict.fromkeys((*STOPWORDS_FR, *STOPWORDS_EN)))


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_text(c: Column) -> Column:
    """Whether strip leaves anything: looks no further than the first character that is no white space; false for null."""
    return F.coalesce(F.rlike(c, F.lit(r"(?U)\S")), F.lit(False))


def doc_id(name: Column, prefix: str = "doc_") -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(name, 256), F.lit(16)))


def video_doc_id(url: Column) -> Column:
    """`yt_` and the video's id; null for any other URL."""
    return F.concat(F.lit("yt_"), youtube_id(url))


def content_hash(markdown: Column) -> Column:
    return F.sha2(markdown, 256)


def file_fingerprint(name: Column, size: Column, mtime: Column, n: int) -> Column:
    return F.left(F.sha2(F.concat_ws(":", name, size.cast("string"), F.floor(mtime).cast("string")), 256), F.lit(n))


def point_id(document: Column, index: Column) -> Column:
    """UUID version 5 of `document#index` in POINT_NAMESPACE."""
    name = F.encode(F.concat(document, F.lit("#"), index.cast("string")), "UTF-8")
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), name))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(document: Column, index: Column) -> Column:
    """The index has four digits at least; longer ones are not cut."""
    digits = index.cast("string")
    return F.concat(document, F.lit("_c"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def safe_cache_name(stem: Column) -> Column:
    return F.regexp_replace(stem, r"(?U)[^\w\-. ]", "_")


def title_from_h1(markdown: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_extract(markdown, r"(?dm)^#\s+(.+)$", 1)), F.lit("")), stem)


def legit_title(title: Column, stem: Column) -> Column:
    """Whether a title isn't a template's and shares a word of four letters or more with the file's name."""
    low = strip(F.lower(title))
    long_words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w{4,})"), 1)
    template = low.isin(*TEMPLATE_TITLES)
    for p in TEMPLATE_PREFIXES:
        template = template | low.startswith(p)
    return ~template & F.arrays_overlap(long_words(title), long_words(stem))


def format_timestamp(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def collapse_blank_lines(markdown: Column, title: Column) -> Column:
    body = strip(F.regexp_replace(markdown, r"\n{3,}", "\n\n"))
    return F.when(F.startswith(body, F.lit("#")), body).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), body))


def clean_links(urls: Column) -> Column:
    """The http and https links, each once, in order."""
    return F.array_distinct(F.filter(F.transform(urls, strip), lambda u: F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://"))))


def flatten_note(xhtml: Column) -> Column:
    t = F.regexp_replace(xhtml, r"(?i)</(p|div|li|tr|h[1-6]|blockquote|pre)\s*>|<br\s*/?>(?:</br>)?", "\n")
    t = F.regexp_replace(t, r"(?i)</t[dh]\s*>", " | ")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", ""), r"mmarch://bin/[A-Fa-f0-9-]+\.bin", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(t, "\n"), strip), "\n"))


def html_title(html: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), r"^\s+|\s+$", ""), F.lit("")), stem)


def _plain(c: Column) -> Column:
    """One line without bold, italics, heading marks and backticks."""
    c = F.regexp_replace(F.regexp_replace(c, r"[\n\r]", " "), r"\*\*([^*]+)\*\*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\*([^*]+)\*", "$1"), r"#+\s*", ""), "`+", "")


def _shorten(c: Column, most: int, least: int) -> Column:
    """At most `most` characters: cut, back to the last space if that is beyond `least`, and `...`. c is evaluated once."""

    def short(x: Column) -> Column:
        cut = F.left(x, F.lit(most - 3))
        space = F.length(cut) - F.instr(F.reverse(cut), " ")
        whole = F.when((F.instr(cut, " ") > 0) & (space > least), F.substring(cut, F.lit(1), space)).otherwise(cut)
        return F.when(F.length(x) > most, F.concat(whole, F.lit("..."))).otherwise(x)

    return F.get(F.transform(F.array(c), short), 0)


def sanitize_alt(c: Column) -> Column:
    """An image's alternative text on one line, without markup, brackets and straight quotes, of 150 characters at most; null gives ""."""
    c = F.translate(_plain(F.coalesce(c, F.lit(""))), "[]'\"", "()’«")
    return _shorten(strip(F.regexp_replace(c, r"(?U)\s+", " ")), 150, 100)


def image_block(description: Column, reference: Column) -> Column:
    """The description in italics and an image with an alternative text of 80 characters at most; "" without a description."""
    rich = strip(F.regexp_replace(_plain(description), r"(?U)\s+", " "))
    short = _shorten(sanitize_alt(description), 80, 50)
    block = F.concat(F.lit("*"), rich, F.lit("*\n\n!["), short, F.lit("]("), reference, F.lit(")"))
    return F.when(F.coalesce(F.length(description), F.lit(0)) == 0, "").otherwise(block)


def is_decorative(description: Column) -> Column:
    phrases = F.array(*map(F.lit, DECORATIVE_PHRASES))
    return F.coalesce(F.exists(phrases, lambda p: F.contains(F.lower(description), p)), F.lit(False))


def mime_for_ext(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit("image/png"))


def sniff_format(data: Column) -> Column:
    """The extension that the first bytes tell; "" if unknown or under 8 bytes."""
    head = F.hex(F.substring(data, 1, 12))
    found = F.when(F.length(data) < 8, "").when(F.startswith(head, F.lit("89504E470D0A1A0A")), ".png").when(F.startswith(head, F.lit("FFD8FF")), ".jpg")
    found = found.when(F.startswith(head, F.lit("47494638")), ".gif").when(F.startswith(head, F.lit("424D")), ".bmp")
    return found.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), ".webp").otherwise("")


def image_dimensions(data: Column) -> Column:
    """struct(width, height) of a PNG; zeros for other formats."""
    part = lambda at: F.when(sniff_format(data) == ".png", F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("bigint")).otherwise(F.lit(0))
    return F.struct(part(17).alias("width"), part(21).alias("height"))


def keep_image(n_bytes: Column, width: Column, height: Column, unknown: bool = True) -> Column:
    """2000 bytes, 80 wide and 60 high at least; images of unknown size (zeros) are kept if `unknown`."""
    big = (width >= 80) & (height >= 60)
    return (n_bytes >= 2000) & ((big | (width == 0)) if unknown else big)


def decode_data_uri(src: Column) -> Column:
    """struct(bytes, ext) of a base64 image of 2000 bytes to 10 MiB; null otherwise."""
    kind = F.regexp_extract(src, r"(?s)^data:image/(png|jpeg|jpg|gif|bmp|webp);base64,(.+)$", 1)
    data = F.try_to_binary(F.regexp_extract(src, r"(?s)^data:image/(?:png|jpeg|jpg|gif|bmp|webp);base64,(.+)$", 1), F.lit("base64"))
    ext = F.concat(F.lit("."), F.when(kind == "jpeg", "jpg").otherwise(kind))
    return F.when((kind != "") & (F.length(data) >= 2000) & (F.length(data) <= 10 * 1024 * 1024), F.struct(data.alias("bytes"), ext.alias("ext")))


def chunk_images(text: Column, most: int = 8) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(rf"!\[[^\]]*\]\(((?:{IMAGE_SCHEME}|https?)://[^)\s]+)\)"), 1), 1, most)


def publish_images(markdown: Column, base_url: str | None) -> Column:
    """Image references as links under base_url; unchanged without one."""
    if not base_url:
        return markdown
    return F.regexp_replace(markdown, IMAGE_SCHEME + r"://([^/\s)]+)/([^/\s)]+)/([^/\s)]+)", base_url.rstrip("/") + "/collections/$1/images/$2/$3")


def safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]+\z") & ~c.isin(".", ".."), F.lit(False))


def remote_docid(url: Column, base: str, page: str = "document.send.php") -> Column:
    """The numeric docid of a document link under base; null otherwise."""
    value = F.try_parse_url(url, F.lit("QUERY"), F.lit("docid"))
    return F.when(F.startswith(url, F.lit(base)) & F.contains(url, F.lit(page)) & value.rlike(r"^\d+$"), value)


def youtube_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, VIDEO_ID, 1), F.lit(""))


def shorten_source(c: Column) -> Column:
    return F.when(F.length(c) > 70, F.concat(F.lit("..."), F.right(c, F.lit(67)))).otherwise(c)


def truncate_text(c: Column, n: int, tail: str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(tail))).otherwise(c)


def raw_tokens(c: Column) -> Column:
    """All tokens as they stand, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({TOKEN})"), 1)


def is_token(t: Column) -> Column:
    """Whether a lower-case token counts: two characters or more, no stopword."""
    return (F.length(t) > 1) & ~t.isin(*STOPWORDS)


def tokenize(c: Column) -> Column:
    """Lower-case tokens of two characters or more that are no stopwords, in order."""
    return F.filter(F.transform(raw_tokens(c), F.lower), is_token)


def l2_normalize(v: Column) -> Column:
    """v over its length, or v if that is under 1e-12."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm < 1e-12, x.cast("double")).otherwise(x.cast("double") / norm))


def parse_rerank_reply(reply: Column, n: Column) -> Column:
    """map id -> score (0 to 10) of a JSON reply, or of what stands between its first and last bracket if the whole isn't JSON.

    Code fences go wherever they stand. An item counts if it is an object whose id is an integer below n; a missing score is 0,
    a fraction is cut, text must be an integer, true is 1. Other items are skipped, the last of equal ids wins.
    Anything but a JSON array gives an empty map. Java's parser reads the first JSON value of a text, so what follows must be blank.
    """
    bare = strip(F.regexp_replace(strip(F.regexp_replace(reply, r"```(?:json)?", "")), r"`+$", ""))
    part = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    listed = lambda c: F.from_json(F.when(F.startswith(c, F.lit("[")), c), "array<string>", {"mode": "PERMISSIVE"})
    array = F.when(F.startswith(bare, F.lit("{")), F.lit(None)).otherwise(F.when(F.endswith(bare, F.lit("]")) & listed(bare).isNotNull(), bare).otherwise(part))
    # Two arrays with text between them aren't one array: outside of strings, brackets must close at the end only.
    outside = F.regexp_replace(F.regexp_replace(array, r'"(?:\\.|[^"\\])*"', ""), r"[^\[\]]", "")
    depth = F.transform(F.sequence(F.lit(1), F.length(outside)), lambda i: 2 * F.length(F.replace(F.left(outside, i), F.lit("]"), F.lit(""))) - i)
    whole = (F.length(outside) > 0) & (F.array_position(depth, F.lit(0)) == F.length(outside))
    items = F.filter(F.when(whole, listed(array)), lambda x: F.startswith(F.ltrim(x), F.lit("{")))
    integer = lambda raw, c: F.when(F.rlike(raw, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(raw).try_cast("decimal(38,0)"))

    def number(item: Column, name: str) -> Column:
        """The value as int() takes it; the kind of the value is told by its JSON text."""
        value = F.get_json_object(item, f"$.{name}")
        quoted = F.rlike(item, F.lit(rf'"{name}"\s*:\s*"'))
        whole = F.when(value == "true", F.lit(1)).when(value == "false", F.lit(0)).otherwise(F.when(quoted, integer(value, name)).otherwise(F.floor(F.abs(value.try_cast("double"))) * F.signum(value.try_cast("double"))))
        return F.when(F.rlike(item, F.lit(rf'"{name}"\s*:')), whole).otherwise(0 if name == "score" else -1).try_cast("bigint")

    clean = F.transform(items, lambda x: F.struct(number(x, "id").cast("int").alias("id"), F.greatest(F.lit(0), F.least(F.lit(10), number(x, "score"))).cast("int").alias("score"), number(x, "score").isNotNull().alias("good")))
    clean = F.filter(clean, lambda x: x["id"].isNotNull() & x["good"] & (x["id"] >= 0) & (x["id"] < n))
    empty = F.create_map().cast("map<int,int>")
    put = lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["id"]), F.create_map(x["id"], x["score"]))
    return F.coalesce(F.aggregate(clean, empty, put), empty)


def parse_expansions(question: Column, reply: Column, most: int = 3) -> Column:
    """The question, then the first `most` lines of the reply of three characters or more, without leading digits, dots, dashes, stars and brackets and without blanks and quotes around."""
    line = lambda x: F.regexp_replace(F.regexp_replace(strip(x), r"^[\d.\-*)]+\s*", ""), "^[ \"']+|[ \"']+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), line), lambda x: F.length(x) >= 3)
    return F.concat(F.array(question), F.slice(lines, 1, most))


def context_prefix(title: Column, path: Column, piece: Column) -> Column:
    """`[title > h1 > h2]`, a blank line and the piece; the piece alone if title and path are empty."""
    whole = F.concat(F.when(F.coalesce(F.length(title), F.lit(0)) > 0, F.array(title)).otherwise(F.array().cast("array<string>")), path)
    return F.when(F.size(whole) > 0, F.concat(F.lit("["), F.array_join(whole, " > "), F.lit("]\n\n"), piece)).otherwise(piece)


def blend_scores(llm: Column, rrf: Column) -> Column:
    """0.8 of the score of 0 to 10 (null: 0) and 0.2 of ten times the fused score, 1 at most."""
    return 0.8 * F.coalesce(llm, F.lit(0)) / 10 + 0.2 * F.least(10 * rrf, F.lit(1.0))
