from shardwright.llm import language_id


def test_text_in_any_tag():
    """An article in div, li and h3 blocks counts beside a notice in a p."""
    page = ("<html><body><nav><div>Menu of it</div></nav><p>We use cookies.</p><div><h3>Ein Titel</h3><div>Ein langer Text</div><ul><li>Noch ein Punkt</li></ul>"
            "<div><a href=/x>Nur ein Verweis</a></div></div><footer><div>Impressum</div></footer><form><div>Suche</div></form>loser Text</body></html>")
    assert language_id.paragraph_text(page).split("\n") == ["We use cookies.", "Ein Titel", "Ein langer Text", "Noch ein Punkt", "loser Text"]
    assert language_id.paragraph_text("<nav>nur dies</nav>") == "nur dies"
