"""Text as column expressions: folding, words, similarity, addresses, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they fold to, pairwise (fixed values).
FOLD_FROM = "áàâäãåéèêëíìîïóòôöõøúùûüçñýÿß"
FOLD_TO = "aaaaaaeeeeiiiioooooouuuucnyys"
#: Query parameters that only track (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")


def fold(text: Column) -> Column:
    """Lower case, no accents, other characters to single spaces."""
    plain = F.translate(F.lower(text), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def word_set(folded: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(folded, " "), ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def canonical_url(url: Column) -> Column:
    """https, no www. or m., no fragment, no tracking, sorted parameters, no slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^https?://(www\\.|m\\.)?", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.element_at(F.split(p, "="), 1).isin(*TRACKING))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.concat(F.lit("https://"), path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


def html_text(html: Column) -> Column:
    """Visible text on one line."""
    hidden = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    shown = F.regexp_replace(hidden, "<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        shown = F.replace(shown, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(shown, "[ \\t\\n\\r]+", " "))
