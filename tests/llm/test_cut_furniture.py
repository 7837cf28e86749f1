"""Operator 1: furniture inside the content element costs nothing, its tags as little as its words."""

from corpuslens.llm import extract as X


def test_long_list_of_links_does_not_end_the_region():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(60))
    page = f"<article><h1>Head</h1><p>{'word ' * 80}</p><div class=related><ul>{links}</ul></div><p>The closing paragraph is part of it.</p></article>"
    assert X.main_text(page, X.DEFAULT).split("\n")[-1] == "The closing paragraph is part of it."
