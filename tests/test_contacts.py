from leadloom.config import LeadConfig
from leadloom.functions import company, contacts
from leadloom.functions.entities import decode_all_entities, decode_entities

CONFIG = LeadConfig(junk_email_domains=["junk.io"])


def coded(email: str, key: int) -> str:
    return bytes([key, *(c ^ key for c in email.encode())]).hex()


def test_plain_emails(values):
    page = "Mail Mary.Lee@Harbour.org., mary.lee@harbour.org; user@harbour.org icon@2x.png x@example.com <a href='mailto:team@harbour.org?subject=a'>"
    assert values(contacts.plain_emails, page, "none", "", None) == [["mary.lee@harbour.org", "team@harbour.org"], [], [], None]
    assert values(contacts.plain_emails, "a" * 80 + "@harbour.org") == [[]]


def test_coded_emails(values):
    code = coded("sales@harbour.org?subject=x", 0x5A)
    page = f'<a data-cfemail="{code}"></a><a href="/cdn-cgi/l/email-protection#{coded("info@harbour.org", 7)}">'
    assert sorted(values(contacts.coded_emails, page)[0]) == ["info@harbour.org", "sales@harbour.org"]
    assert values(contacts.decode_email, code, "5a", "5", "", "zz11", "5a3") == ["sales@harbour.org?subject=x", "", "", "", "", ""]
    assert values(contacts.all_emails, page + " sales@harbour.org")[0].count("sales@harbour.org") == 1


def test_phones(values):
    linked = '<a href="tel:+44%2020%207946%200018">x</a> 0161 496 1234'
    assert values(contacts.phones, linked, "call &#x2B;44 20 7946 1958, +44-20-7946-1958", "price 1234.56 789", "(0161) 496 1234 and 000-000-0000", "", None) == [
        ["+44 20 7946 0018"], ["+44 20 7946 1958"], [], ["(0161) 496 1234"], [], None,
    ]
    assert values(contacts.phones, '<a href="tel:000 000">x</a> 0161 496 1234') == [["0161 496 1234"]]


def test_scores(values):
    assert values(lambda c: contacts.email_score(c, CONFIG), "mary.lee@harbour.org", "info@harbour.org", "sales@harbour.org", "no-reply@harbour.org", "mary@my-junk.io", "nothing", None) == [1, 2, 3, 999, 999, 999, 999]
    assert values(lambda c: contacts.best_email(c, CONFIG), ["sales@h.org", "info@h.org", "zoe@h.org", "amy@h.org"], ["noreply@h.org"], [], kind="array<string>") == ["amy@h.org", None, None]


def test_entities(values):
    assert values(decode_entities, "a &amp;lt; b &#43;&#x28; &nbsp;&unknown; & &#233;", "plain", "", None) == ["a &lt; b +(  &unknown; & é", "plain", "", None]
    assert values(decode_all_entities, "&eacute;&#233;&amp;", None) == ["éé&", None]


def test_company_name(spark, values):
    from pyspark.sql import functions as F

    name = lambda c: company.company_name(c, F.lit("fallback"))
    assert values(
        name,
        "<meta property='og:site_name' content='Harbour &amp; Sons'><title>Other</title>", "<title>Harbour Homes | Home</title>", "<title>Harbour Homes - Leeds and York</title>",
        "<title>AB</title><meta content='Harbour Co | Welcome' property='og:title'>", "<h1 class='x'>Harbour <b>Works</b></h1>", "<p>nothing</p>", None,
    ) == ["Harbour & Sons", "Harbour Homes", "Harbour Homes", "Harbour Co", "Harbour Works", "fallback", "fallback"]
