"""Captions stay with the media of their figure, and nothing of a page is lost."""

from __future__ import annotations

import pytest

from veritab.llm import media


def items(html):
    return [(i["kind"][0], i["text"] or i["ref"], i["caption"]) for i in media.parse_items(html)]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<figure><figcaption>Cap</figcaption><img src=a></figure>x", [("m", "a", "Cap"), ("t", "x", None)]),
        ("<img src=a><img src=b alt=B><figcaption>Stray</figcaption>", [("m", "a", None), ("m", "b", "B"), ("t", "Stray", None)]),
        ("<picture><source srcset='a.webp 2x, b.webp'><img srcset='c.png 1x'></picture>", [("m", "c.png", None)]),
        ("<picture><source srcset=a.webp><img alt=A></picture><picture><source srcset=z></picture>", [("m", "a.webp", "A"), ("m", "z", None)]),
        ("one<template>two<p>three", [("t", "one two three", None)]),
        ("one<template>two<img src=a></template>three", [("t", "one three", None)]),
        ("<figure><img src=a><img src=b><figcaption>Both <b>of</b> them</figcaption></figure>", [("m", "a", "Both of them"), ("m", "b", "Both of them")]),
        ("<figure><img src=a><figure><img src=b><figcaption>In</figcaption></figure><figcaption>Out</figcaption></figure>", [("m", "a", "Out"), ("m", "b", "In")]),
        ("<figure><figure><img src=b></figure><figcaption>Out</figcaption></figure>", [("m", "b", "Out")]),
        ("<figure><table><tr><td>1</table><figcaption>Table</figcaption></figure>z", [("t", "1", None), ("t", "Table", None), ("t", "z", None)]),
        ("<figure><img src=a><figcaption>Never closed", [("m", "a", "Never closed")]),
        ("<script>no<img src=q></script><video><source src=v></video><style>p {}</style>yes</figure></template>", [("m", "v", None), ("t", "yes", None)]),
        ("", []),
    ],
)
def test_captions(html, want):
    assert items(html) == want
