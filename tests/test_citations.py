import gzip

from inkgraph.sources import citations

ONE = """<PubmedArticle><MedlineCitation Status="X"><PMID Version="1"> 7 </PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>Issue 12345, Spring 1998-1999</MedlineDate></PubDate></JournalIssue><Title>%s</Title></Journal>
<ArticleTitle>On <i>small</i> &amp; large</ArticleTitle><Abstract><AbstractText>%s</AbstractText><AbstractText>second</AbstractText></Abstract>
<AuthorList><Author ValidYN="Y"><LastName>O&apos;Hara</LastName><ForeName>Lee</ForeName></Author><Author><LastName>Roe</LastName></Author><Author><CollectiveName>Group</CollectiveName></Author>%s</AuthorList></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1"> Cells </DescriptorName></MeshHeading><MeshHeading><DescriptorName>%s</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">7</ArticleId><ArticleId IdType="doi">10.1/a</ArticleId></ArticleIdList><ReferenceList>
<Reference><Citation>first</Citation><ArticleIdList><ArticleId IdType="pubmed">70</ArticleId></ArticleIdList></Reference><Reference/>
<Reference><ArticleTitle>%s</ArticleTitle><ArticleIdList><ArticleId IdType="pubmed">71</ArticleId></ArticleIdList></Reference>
<Reference><ArticleIdList><ArticleId IdType="pubmed">PMC9</ArticleId></ArticleIdList></Reference>
<Reference><ArticleTitle>again</ArticleTitle><ArticleIdList><ArticleId IdType="pubmed">71</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>
""" % ("j" * 501, "a" * 5001, "<Author><LastName>P</LastName></Author>" * 60, "k" * 201, "t" * 1001)
TWO = "<PubmedArticle><MedlineCitation><PMID>8</PMID><Article><Journal><JournalIssue><PubDate><Year>1776</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>"
NO_ID = "<PubmedArticle><MedlineCitation><PMID> </PMID></MedlineCitation></PubmedArticle>"


def test_records_fields_and_references(spark, tmp_path):
    with gzip.open(tmp_path / "a.xml.gz", "wt") as f:
        f.write(f'<?xml version="1.0"?>\n<PubmedArticleSet>\n{ONE}{TWO}\n</PubmedArticleSet>\n')
    (tmp_path / "b.xml").write_text(f"<PubmedArticleSet>{NO_ID}</PubmedArticleSet>")
    records = citations.read_citation_records(spark, f"file://{tmp_path}")
    assert records.count() == 3
    fields = citations.citation_fields(records)
    rows = {r.pmid: r for r in fields.collect()}
    assert set(rows) == {"7", "8"}
    one, two = rows["7"], rows["8"]
    assert one.title == "On small & large" and one.journal == "j" * 500 + "..." and one.abstract == "a" * 5000 + "..." and one.doi == "10.1/a" and one.year == "1998"
    assert one.authors == ["Lee O'Hara", "Roe"] + ["P"] * 47 and one.keywords == ["Cells"]
    assert (two.title, two.journal, two.abstract, two.doi, two.year, two.authors, two.keywords) == (None, None, None, None, None, [], [])
    cited = sorted((r.citing, r.cited, r.title) for r in citations.cited_records(fields).collect())
    assert cited == [("7", "70", None), ("7", "71", "t" * 1000 + "...")]
    assert citations.cited_records(citations.citation_fields(records.limit(0))).count() == 0
