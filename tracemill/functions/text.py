"""Classifiers and rewrites over message text. Pattern lists are parameters; the defaults are the
retail customer's phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop token, phrase lists, limits and hint texts the classifiers must agree on.
STOP_TOKEN = "###STOP###"
CLOSING_MAX_CHARS = 160
CLOSING_PHRASES = (r"thanks?|thank you|bye|goodbye|take care|you too|appreciate|that'?s all|"
                   r"that will be all|that'?s it|nothing else|have a (great|nice|good|wonderful|lovely)")
NEW_REQUEST_PHRASES = (r"also|another|actually|but|however|wait|can you|could you|would you|need|want|"
                       r"order|#W\d|confirm|proceed|go ahead")
ENDING_PHRASES = r"that'?s all|that covers|that will be all|nothing else|good ?bye|bye"
PREMATURE_PHRASES = (r"yes|yeah|go ahead|proceed|confirm|i('d| would) like|i want|can you|could you|"
                     r"please (do|cancel|return|exchange|modify|change|update|process|send|refund|use)")
SWAP_TOOLS = ("modify_pending_order_items", "exchange_delivered_order_items")
SWAP_HINT = (" (Hint: item_ids and new_item_ids are matched by position: the i-th new item replaces"
             " the i-th item and must be a variant of the same product. List only the items that"
             " change; an item cannot be replaced by itself.)")
LOOKUP_HINT = " (Hint: do not guess ids; look them up from the customer's details and their orders.)"
ENTITY_PATTERN = r"#W\d+|\b\d{10}\b|[a-z]+_[a-z]+_\d+"
HEAD_PATTERN = (r"(?s)^Your name is (.+?) and your (?:email is (\S+?)|zip code is (\d{5}))\. "
                r"You are ([^.]*)\.\s*(.*)$")


def _word(phrases: str) -> str:
    return rf"(?iU)\b({phrases})\b"


def _word_or_question(phrases: str) -> str:
    return rf"(?iU)\?|\b({phrases})\b"


def without_stop(text: Column, stop: str = STOP_TOKEN) -> Column:
    """Text with the stop token removed and outer whitespace trimmed."""
    return F.regexp_replace(F.replace(text, F.lit(stop), F.lit("")), r"^\s+|\s+$", "")


def is_closing_only(text: Column, closing: str = CLOSING_PHRASES, request: str = NEW_REQUEST_PHRASES,
                    max_chars: int = CLOSING_MAX_CHARS, stop: str = STOP_TOKEN) -> Column:
    t = without_stop(text, stop)
    n = F.char_length(t)
    return ((n > 0) & (n <= F.lit(max_chars)) & t.rlike(_word(closing))
            & ~t.rlike(_word_or_question(request)))


def premature_stop(text: Column, request: str = PREMATURE_PHRASES, ending: str = ENDING_PHRASES,
                   stop: str = STOP_TOKEN) -> Column:
    t = without_stop(text, stop)
    return text.contains(stop) & t.rlike(_word_or_question(request)) & ~t.rlike(_word(ending))


def tool_hint(name: Column, content: Column) -> Column:
    return (F.when(~content.startswith("Error"), F.lit(""))
            .when(name.isin(*SWAP_TOOLS), F.lit(SWAP_HINT))
            .when(F.lower(content).contains("not found"), F.lit(LOOKUP_HINT))
            .otherwise(F.lit("")))


def said(message: Column, info: Column) -> Column:
    """The info string occurs in one message. Commas are removed from the message only, so an info
    that itself holds a comma can never match."""
    return F.contains(F.replace(F.lower(F.coalesce(message, F.lit(""))), F.lit(","), F.lit("")), F.lower(info))


def communicated(messages: Column, infos: Column) -> Column:
    """Every info is said in some message; true when there is nothing to say."""
    return F.forall(infos, lambda i: F.exists(messages, lambda m: said(m, i)))


def entities(text: Column, pattern: str = ENTITY_PATTERN) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def instruction_head(text: Column) -> Column:
    """name, email, zip, traits and body of a scripted instruction; ok is false when it has another
    shape."""
    g = [F.regexp_extract(text, HEAD_PATTERN, i) for i in range(1, 6)]
    return F.struct(text.rlike(HEAD_PATTERN).alias("ok"), g[0].alias("name"),
                    F.nullif(g[1], F.lit("")).alias("email"), F.nullif(g[2], F.lit("")).alias("zip"),
                    g[3].alias("traits"), F.trim(g[4]).alias("body"))


def and_list(names: Column) -> Column:
    """"a", "a and b", "a, b and c"."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.array_join(names, "")).otherwise(
        F.concat(head, F.lit(" and "), F.element_at(names, -1)))


def option_words(options: Column) -> Column:
    """"k v, k v" from an options map, in key order."""
    entries = F.array_sort(F.map_entries(options))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" "), e["value"])), ", ")


def payment_phrase(source: Column, brand: Column, last_four: Column) -> Column:
    return (F.when(source == "gift_card", F.lit("gift card")).when(source == "paypal", F.lit("PayPal account"))
            .otherwise(F.concat(F.coalesce(brand, F.lit("credit")), F.lit(" card ending in "), last_four)))


def money(x: Column) -> Column:
    return F.printf(F.lit("%.2f"), x)


def trimmed_money(x: Column) -> Column:
    """Two decimals with trailing zeros and a trailing point removed."""
    return F.regexp_replace(F.regexp_replace(money(x), "0+$", ""), r"\.$", "")


def tidy_described(body: Column) -> Column:
    """Wording fixes after ids were replaced by descriptions."""
    body = F.regexp_replace(body, r"\bCancel order your\b", "Cancel your")
    body = F.regexp_replace(body, r"\bReturn your\b", "Return items from your")
    return F.regexp_replace(body, r"\bvia your\b", "using your")


def replace_all(body: Column, pairs: Column) -> Column:
    """Apply (needle, text) replacements in order; a null text leaves the needle."""
    return F.aggregate(pairs, body, lambda acc, p: F.replace(acc, p["needle"], F.coalesce(p["text"], p["needle"])))
