"""Plain words of a text: what case, punctuation, markup, line-end hyphens, invisible and look-alike characters leave."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters that look like Latin ones, each with that letter; the capitals come before lower-casing.
CAPITALS = "Α a Β b Ε e Ζ z Η h Ι i Κ k Μ m Ν n Ο o Ρ p Τ t Υ y Χ x Ӏ l І i Ј j Ѕ s".split()
SMALL = "а a е e о o р p с c у y х x і i ј j ѕ s ԁ d һ h ӏ l к k м m т t в b н h г r п n ԛ q ԝ w ѵ v ο o α a ε e ρ p υ u ι i κ k ν v τ t η n χ x γ y ϲ c ϳ j ɡ g ı i ɑ a ʏ y".split()
TO_LATIN = [str.maketrans(dict(zip(x[::2], x[1::2], strict=True))) for x in (CAPITALS, SMALL)]
INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|code|mark|sub|sup|font|small|big|tt|kbd|del|ins|q)(?:\s[^<>]{0,300})?>", re.I)
TAG = re.compile(r"</?[a-z][a-z0-9]{0,15}(?:\s[^<>]{0,300})?/?>|<!--.{0,500}?-->", re.I | re.S)
LINK = re.compile(r"\[([^\[\]]{0,500})\]\([^()\s]{0,500}\)")
BROKEN = re.compile(r"(?<=\w)[-‐‑][ \t]*\r?\n[ \t]*(?:[>#*/;%|-]{1,4}[ \t]*)*(?=\w)")
WORD = re.compile(r"[^\W_]+")
JOINED = re.compile(r"(?<=\w)['’ʼ‐‑-](?=\w)")
INVISIBLE = re.compile("[͏ᅟᅠ឴឵᠋-᠎ㅤﾠ]")


def plain(text: str) -> str:
    """One spelling for all: hyphens and apostrophes inside words are dropped, so that a line-end hyphen makes no difference."""
    t = text
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
        t = INVISIBLE.sub("", "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Mn", "Me")))
    if "<" in t:
        t = TAG.sub(" ", INLINE.sub("", t))
    if "](" in t:
        t = LINK.sub(r"\1", t)
    t = BROKEN.sub("", t)
    t = t.replace("*", "").replace("`", "").replace("~~", "")
    if not t.isascii():
        t = t.translate(TO_LATIN[0]).lower().translate(TO_LATIN[1])
    return JOINED.sub("", t).lower()


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))
