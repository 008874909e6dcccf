"""A transport over one JSON file of articles and works, which logs each request."""

import json
import os
import uuid


def answer(kind, params, options):
    with open(options["store"]) as f:
        store = json.load(f)
    with open(os.path.join(options["log"], uuid.uuid4().hex), "w") as f:
        json.dump([kind, params], f)
    if kind == "esearch":
        return json.dumps({"esearchresult": {"idlist": store["found"].get(params["term"], [])}})
    if kind == "efetch":
        articles = "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>T{i}</ArticleTitle></Article></MedlineCitation></PubmedArticle>" for i in params["id"].split(","))
        return f"<PubmedArticleSet>{articles}</PubmedArticleSet>"
    works = store["works"][params["search"]]
    at = 0 if params["cursor"] == "*" else int(params["cursor"])
    page = works[at : at + params["per_page"]]
    then = at + params["per_page"]
    return json.dumps({"meta": {"next_cursor": str(then) if then <= len(works) else None}, "results": [{"id": f"https://openalex.org/W{i}", "title": f"T{i}", "doi": "https://doi.org/10.1/x", "abstract_inverted_index": {"b": [1], "a": [0]}} for i in page]})
