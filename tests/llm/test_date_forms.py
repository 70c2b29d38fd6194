"""Dates in other layouts and numbers of other countries get pseudonyms in their own layout."""

import re

from pyspark.sql import functions as F

from matchframe.llm import pseudonyms

DATES = {
    "12/31/1999": r"\d\d/\d\d/\d{4}", "31.12.1999": r"\d\d\.\d\d\.\d{4}", "1/5/2020": r"\d\d?/\d\d?/\d{4}", "31/12/1999": r"(1[3-9]|[23]\d)/\d\d/\d{4}",
    "5 March 2020": r"\d\d? [A-Z][a-z]+ \d{4}", "March 5th, 2020": r"[A-Z][a-z]+ \d\d?(st|nd|rd|th), \d{4}", "7. März 2020": r"\d\d?\. [A-Z][a-zä]+ \d{4}",
    "8 de marzo de 2020": r"\d\d? de [a-z]+ de \d{4}", "09 AUG 2020": r"\d\d [A-Z]+ \d{4}",
}
PHONES = {"+49 30 1234567": r"\+49 \d\d \d{7}", "+33 1 23 45 67 89": r"\+33 \d( \d\d){4}", "+49 (0)30 123456": r"\+49 \(0\)\d\d \d{6}", "+442071838750": r"\+44\d{10}"}
STAY = ["30/02/2020", "31 June 2020", "32.01.2020", "+49 12", "1/5/20201", "May 2020"]


def test_forms_are_found_and_kept(spark, documents):
    values = [*DATES, *PHONES, *STAY]
    rows = [(k, f"on {v}, so") for k, v in enumerate(values)] + [(100, "2020-03-05 or March 5, 2020 or 5.3.2020 or 3/5/2020")]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(documents(rows)).collect()}
    for k, v in enumerate(values):
        r = got[k]
        assert (r.n_date, r.n_phone) == (int(v in DATES), int(v in PHONES)), (v, r.text)
        new = re.fullmatch("on (.*), so", r.text)[1]
        assert new == v if v in STAY else new != v and re.fullmatch((DATES | PHONES)[v], new), (v, new)
    iso, name, dots, slashes = got[100].text.split(" or ")
    y, m, d = (int(x) for x in iso.split("-"))
    assert dots == f"{d}.{m}.{y}" and slashes == f"{m}/{d}/{y}" and name == f"{pseudonyms.MONTHS[m - 1].title()} {d}, {y}"


def test_day_first_dates_are_a_bijection(spark):
    days = spark.range(0, 73049, 9).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12")
    got = days.select(pseudonyms._date(F.date_format("d", "dd/MM/yyyy"), "k").alias("n"))
    assert got.where(F.substring("n", 1, 2).cast("int") > 12).distinct().count() == days.count()
