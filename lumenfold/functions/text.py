"""Scalar text functions as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of section headings, by class; the first class in this order that fits decides.
SECTION_WORDS = {
    "introduction": ("introduction", "背景", "はじめに", "序論"),
    "methods": ("method", "approach", "methodology", "手法", "方法", "提案手法"),
    "results": ("result", "experiment", "evaluation", "結果", "実験", "評価"),
    "discussion": ("discussion", "考察", "議論", "analysis"),
    "conclusion": ("conclusion", "summary", "結論", "まとめ", "おわりに"),
    "related_work": ("related", "先行研究", "関連研究", "background"),
    "abstract": ("abstract", "概要", "要旨"),
    "references": ("references", "bibliography", "参考文献", "引用文献"),
}

#: File suffixes and their media types.
FORMATS = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".rst": "text/x-rst",
    ".json": "application/json",
    ".html": "text/html",
    ".htm": "text/html",
    ".xml": "application/xml",
    ".csv": "text/csv",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".doc": "application/msword",
    ".rtf": "application/rtf",
    ".tex": "application/x-tex",
    ".bib": "application/x-bibtex",
}

#: Terms of the academic dictionary.
ACADEMIC_TERMS = (
    "transformer", "attention", "bert", "gpt", "lstm", "cnn", "rnn", "neural network", "deep learning", "machine learning",
    "natural language processing", "computer vision", "reinforcement learning", "supervised learning",
    "unsupervised learning", "transfer learning", "embedding", "encoder", "decoder", "tokenizer", "fine-tuning",
    "pre-training", "backpropagation", "gradient descent", "optimizer", "loss function", "batch normalization", "dropout",
    "regularization", "convolution", "pooling", "softmax", "sigmoid", "graph neural network", "knowledge graph",
)

#: Labels of a named-entity recogniser and the types they become.
ENTITY_TYPES = {"PERSON": "RESEARCHER", "ORG": "ORGANIZATION", "PRODUCT": "MODEL", "WORK_OF_ART": "PAPER", "GPE": "LOCATION", "DATE": "DATE", "CARDINAL": "NUMBER", "PERCENT": "PERCENT"}

WORD = r"[\p{L}\p{N}_]+"


def text(c: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise_whitespace(c: Column) -> Column:
    """Runs of spaces and tabs become a space, three or more newlines become two; ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    """Whitespace words, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_set(c: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1)))


def token_count(c: Column) -> Column:
    """Words and punctuation marks, the stand-in for a byte-pair tokenizer. (T5)"""
    return F.regexp_count(c, F.lit(WORD + r"|[^\s\p{L}\p{N}_]"))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(c) * 0.25).cast("long")


def estimated_chunks(n: Column, size: int, overlap: int) -> Column:
    """How many chunks n tokens give, roughly."""
    step = size - overlap
    inner = F.floor(n / size) if step <= 0 else F.greatest(F.lit(1), F.floor((n - overlap) / step) + 1) if step else n
    return F.when(n <= size, F.lit(1)).otherwise(inner).cast("long")


def document_id(doi: Column, arxiv: Column, file_name: Column, title: Column) -> Column:
    """From the DOI, else the arXiv id, else a hash of file name and title."""
    hashed = F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat(text(file_name), F.lit("_"), text(title)), 256), 1, 12))
    present = lambda c: F.when(c != "", c)
    return F.coalesce(F.concat(F.lit("doi_"), F.replace(present(doi), F.lit("/"), F.lit("_"))), F.concat(F.lit("arxiv_"), present(arxiv)), hashed)


def content_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def document_hash(*parts: Column) -> Column:
    """Hash of the parts by lines, nulls as empty."""
    return content_hash(F.concat_ws("\n", *[text(p) for p in parts]))


def sentences(c: Column) -> Column:
    """Split after `.`, `!` or `?` before a capital; the whole text if nothing is left."""
    folded = strip(F.regexp_replace(c, r"\s+", " "))
    parts = F.filter(F.transform(F.split(folded, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def academic_terms(c: Column) -> Column:
    """Dictionary terms that the text contains, in the dictionary's order."""
    low = F.lower(c)
    return F.filter(F.array(*map(F.lit, ACADEMIC_TERMS)), lambda t: F.contains(low, t))


def entity_type(label: Column) -> Column:
    """Type of a recogniser's label; unknown labels stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ENTITY_TYPES.items() for x in kv]), label), label)


def method_names(c: Column) -> Column:
    """CamelCase names and acronyms, sorted."""
    camel = F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), F.lit(1))
    short = F.regexp_extract_all(c, F.lit(r"\b([A-Z]{2,}(?:-[A-Z0-9]+)*)\b"), F.lit(1))
    return F.array_sort(F.array_union(camel, short))


def normalise_title(c: Column) -> Column:
    """Lower-case, only word characters and single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def title_guess(c: Column) -> Column:
    """A quoted title, else what stands before the first full stop if longer than 10."""
    quoted = F.regexp_extract(c, '"([^"]+)"', 1)
    first = strip(F.regexp_extract(c, r"^([^.]*)\.", 1))
    return F.when(quoted != "", quoted).when(F.length(first) > 10, first)


def reference_doi(c: Column) -> Column:
    """The first DOI without trailing punctuation."""
    found = F.regexp_replace(F.regexp_extract(c, r"(10\.\d{4,}/[^\s]+)", 1), r"[.,;:)]+$", "")
    return F.when(found != "", found)


def external_key(c: Column) -> Column:
    """(T23)"""
    return F.concat(F.lit("ext_"), F.substring(F.md5(c), 1, 8))


def normalise_entity(c: Column) -> Column:
    """Lower-case, single spaces, word characters and hyphens."""
    return F.regexp_replace(strip(F.regexp_replace(F.lower(c), r"\s+", " ")), r"[^\p{L}\p{N}_\s\-]", "")


def content_key(c: Column) -> Column:
    """Key of a passage among engines: hash of its first 200 characters, lower-case."""
    return F.md5(F.substring(F.lower(strip(c)), 1, 200))


def cache_key(space: str, **parts: Column) -> Column:
    """`space:name=value:...` by name, nulls left out; hashed when longer than 200."""
    pieces = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in sorted(parts.items())]
    full = F.concat_ws(":", F.lit(space), *pieces)
    return F.when(F.length(full) > 200, F.concat(F.lit(f"{space}:"), F.substring(F.md5(full), 1, 16))).otherwise(full)


def citation_marks(answer: Column, sources: Column) -> Column:
    """Distinct `[n]` of an answer with 1 <= n <= sources, sorted."""
    marks = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda m: m.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(marks, lambda m: (m >= 1) & (m <= sources))))


def answer_confidence(cited_scores: Column, n_context: Column) -> Column:
    """Mean score of cited passages, discounted by the share of the context cited."""
    n = F.size(cited_scores)
    mean = F.aggregate(cited_scores, F.lit(0.0), lambda a, s: a + s) / n
    return F.when((n == 0) | (n_context == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), mean * (0.5 + 0.5 * F.least(n / n_context, F.lit(1.0)))))


def claim_lines(c: Column, most: int) -> Column:
    """Items of a bulleted list, at least five characters long, at most `most`."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda s: s.rlike(r"^(- |・|\* )"))
    bare = F.transform(lines, lambda s: strip(F.regexp_replace(s, r"^(- |・|\* )", "")))
    return F.slice(F.filter(bare, lambda s: F.length(s) >= 5), 1, most)


def braced_json(c: Column, greedy: bool = True) -> Column:
    """A fenced ```json block, else what stands in braces; null if neither."""
    fenced = F.regexp_extract(c, r"(?s)```json\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(c, r"(?s)(\{.*\})" if greedy else r"(?s)(\{.*?\})", 1)
    return F.when(fenced != "", fenced).when(braced != "", braced)


def truncated(c: Column, most: int = 1000) -> Column:
    """(T32)"""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def hashed_embedding(c: Column, dimensions: int = 384) -> Column:
    """A stand-in embedding: bytes of the MD5 between -0.5 and 0.5, repeated."""
    digest = F.md5(c)
    base = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)
    return F.slice(F.flatten(F.array_repeat(base, -(-dimensions // 16))), 1, dimensions)


def support_confidence(n: Column, alone: Column, slope: float = 0.2) -> Column:
    """Grows with the number of sources; a single source keeps its own."""
    return F.when(n > 1, F.least(F.lit(1.0), n * slope + 0.5)).otherwise(alone)


def file_format(path: Column) -> Column:
    """Media type by suffix; null if unsupported. (S3)"""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), suffix)


def section_class(heading: Column) -> Column:
    """(S6)"""
    low, out = F.lower(heading), None
    for kind, words in SECTION_WORDS.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def doi(c: Column) -> Column:
    """(S12)"""
    found = F.regexp_extract(c, r"""(10\.\d{4,}/[^\s\]>"']+)""", 1)
    return F.when(found != "", found)


def arxiv_id(c: Column) -> Column:
    """(S12)"""
    found = F.regexp_extract(c, r"(?i)arXiv:(\d{4}\.\d{4,5}(v\d+)?)", 1)
    return F.when(found != "", found)


def reference_entry(c: Column) -> Column:
    """struct<title,year,doi,arxiv> of a reference line; null below 20 characters."""
    year = F.regexp_extract(c, r"((?:19|20)\d{2})", 1)
    entry = F.struct(F.substring(c, 1, 200).alias("title"), F.when(year != "", year.cast("int")).alias("year"), doi(c).alias("doi"), arxiv_id(c).alias("arxiv"))
    return F.when(F.length(c) >= 20, entry)


def author_names(c: Column) -> Column:
    """Names of one to five words without digits; none if there are more than twenty."""
    names = F.transform(F.split(c, r",\s*|\s+and\s+"), strip)
    kept = F.filter(names, lambda s: (F.size(tokens(s)).between(1, 5)) & ~s.rlike(r"\d"))
    clean = F.filter(F.transform(kept, lambda s: strip(F.regexp_replace(s, "[*†‡§∗]+", ""))), lambda s: s != "")
    return F.when(F.size(clean) > 20, F.array().cast("array<string>")).otherwise(clean)


def heading_level(c: Column) -> Column:
    """(S15)"""
    return F.when(c.rlike(r"^\d+\.\d+\.\d+"), 3).when(c.rlike(r"^\d+\.\d+"), 2).otherwise(1)
