import random
import re

import numpy as np
from pyspark.sql import functions as F

from sondage.llm import stuffing as s

PROSE = (
    "The committee met on Tuesday and agreed that the report should be sent before the end of the month. "
    "Nobody objected, although two members asked for a shorter summary. After a long debate the chair closed the meeting. "
)
FRENCH = "Le comité a approuvé le rapport après l'audience, parce que personne ne s'y opposait. La coopérative doit publier la règle avant la fin du mois. "
TABLE = "\n".join(f"2026-04-{d:02} | {d * 1.7:.2f} kWh | ok" for d in range(1, 29))
SPAM = {
    "keywords": "cheap loan, fast loan, cheap loan online, best loan, cheap loan, fast loan, cheap loan online, best loan, loan near me",
    "piles": "note; deadline; cher; discount; school; modest; privacy; service; letters; seed; credits; days; test; judge; witness; partial; exception",
    "links": "\n".join(f"* https://www.shop{i}.example/c/cheap-loan-{i}.html" for i in range(12)),
    "captions": "\n".join(f"See also cheap loan – https://shop{i}.example/loan" for i in range(9)),
    "markdown": " · ".join(f"[best loan {i}](http://x{i}.test/p/loan)" for i in range(12)),
    "html": "".join(f'<a href="http://x{i}.test/loan">cheap loan</a><br>' for i in range(12)),
    "products": "\n".join(f"Cheap Guard | SKU-{i:05} | XL | red | free shipping" for i in range(13)),
    "hashtags": "#CheapLoan#Fast_Loan2#LoanOnline#BestLoan#CheapLoan#Loan24h#FastLoan#LoanNow",
    "sentences": "buy cheap loan, cheap loan online, best cheap loan fast credit! fast credit vs cheap loan: fast credit review fast credit price! " * 4,
    "spelling": "ch3ap l0an, f​ast loаn, CHEAP LOAN, ｃheap loan, cheap loan, fast loan, cheap loan, fast loan, cheap loan",
}


# Honest prose in ten languages, our own.
HONEST = {
    "de": "Der Ausschuss traf sich am Dienstag und beschloss, den Bericht noch vor dem Ende des Monats zu senden. Niemand widersprach dem Vorschlag, aber zwei Mitglieder baten um eine kürzere Fassung. Nach einer langen Debatte schloss die Leiterin die Sitzung, und der Bericht ging an den Rat.",
    "tr": "Kurul salı günü toplandı ve raporu ay sonundan önce göndermeye karar verdi. Kimse bu öneriye karşı çıkmadı ama iki üye daha kısa bir metin istedi. Uzun bir tartışmadan sonra başkan toplantıyı kapattı ve rapor bir gün içinde meclise ulaştı.",
    "fi": "Valiokunta kokoontui tiistaina ja päätti lähettää raportin ennen kuun loppua. Kukaan ei vastustanut ehdotusta, mutta kaksi jäsentä pyysi lyhyempää tekstiä. Pitkän keskustelun jälkeen puheenjohtaja päätti kokouksen ja raportti meni neuvostolle.",
    "hi": "समिति मंगलवार को मिली और तय किया कि रिपोर्ट महीने के अंत से पहले भेजी जाए। किसी ने विरोध नहीं किया, पर दो सदस्यों ने छोटा पाठ माँगा। लंबी बहस के बाद अध्यक्ष ने बैठक बंद की और रिपोर्ट परिषद को भेजी गई।",
    "zh": "委员会星期二开会，决定在月底以前把报告送出去。没有人反对这个建议，但是有两位委员要求写得短一些。经过很长时间的讨论，主席结束了会议，报告在第二天交给了市议会。",
    "ja": "委員会は火曜日に集まり、月末までに報告書を送ることを決めた。反対する人はいなかったが、二人の委員がもっと短い文を求めた。長い議論の後で議長は会議を閉じ、報告書は次の日に議会へ届けられた。",
    "ar": "اجتمعت اللجنة يوم الثلاثاء وقررت أن ترسل التقرير قبل نهاية الشهر. لم يعترض أحد على الاقتراح، لكن عضوين طلبا نصا أقصر. بعد نقاش طويل أغلقت الرئيسة الجلسة وأرسل التقرير إلى المجلس.",
    "ru": "Комитет собрался во вторник и решил отправить отчёт до конца месяца. Никто не возражал против предложения, но два члена попросили текст покороче. После долгого спора председатель закрыл заседание, и отчёт ушёл в совет.",
    "pt": "O comité reuniu-se na terça-feira e decidiu enviar o relatório antes do fim do mês. Ninguém se opôs à proposta, mas dois membros pediram um texto mais curto. Depois de um longo debate, a presidente encerrou a sessão e o relatório seguiu para o conselho.",
    "sw": "Kamati ilikutana siku ya Jumanne na ikaamua kupeleka ripoti kabla ya mwisho wa mwezi. Hakuna aliyepinga pendekezo hilo, lakini wajumbe wawili waliomba maandishi mafupi zaidi. Baada ya mjadala mrefu mwenyekiti alifunga kikao na ripoti ilipelekwa kwa baraza.",
}


def bare(text):
    """A text without capitals and punctuation."""
    return re.sub(r"[.,;!?।。，、！؟،-]+", " ", text).lower()


def wrapped(text):
    w = text.split(" ")
    return "\n".join(" ".join(w[i : i + 8]) for i in range(0, len(w), 8))


def share(text):
    p = s.page(text)
    return p.stuffing / max(1, p.chars)


def test_honest_prose_of_any_language():
    pages = [f(t) * n for t in HONEST.values() for f, n in ((str, 1), (str, 3), (bare, 1), (wrapped, 1))]
    assert len(pages) == 40
    for t in pages:
        assert share(t) < 0.5, t[:80]


def test_spam_of_any_language():
    for keyword in ("günstiger Kredit", "ucuz kredi", "सस्ता ऋण", "便宜贷款", "قرض رخيص", "дешёвый кредит"):
        for sep in (", ", "\n", " | ", " "):
            assert share(sep.join(f"{keyword} {x}" for x in ("2024", "online", "24", "top", "2025", "xl", "pro", "2026") * 3)) > 0.5, (keyword, sep)


def test_stuffing_is_found_and_honest_text_is_not():
    for name, text in SPAM.items():
        assert share(text) > 0.8, name
        assert share(PROSE + "\n\n" + text * (1 + 900 // len(text))) > 0.5, name
        assert share(PROSE * 30 + "\n\n" + text) < 0.5, name
    for text in (PROSE, FRENCH, PROSE.upper(), PROSE * 20, FRENCH * 20, "Short note.", "Hello", TABLE, PROSE + "\n" + TABLE, "Present: Ana, Bo, Cy, Di\n- " + PROSE, "12 Mill Road\nOldtown\nAB1 2CD", PROSE + "\n#one #two #three"):
        assert share(text) < 0.5, text[:60]
    assert share("".join(f"{x}. (see https://a.example/{i}) " for i, x in enumerate(PROSE.split(". ")))) < 0.5
    assert share("Der Ausschuss traf sich am Dienstag und beschloss den Bericht sofort zu senden. Niemand widersprach dem Vorschlag trotz langer Debatte.") < 0.5


def test_repeats_against_brute_force():
    rng = random.Random(1)
    pages = []
    for _ in range(500):
        t = [rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 24))]
        n = len(t)
        pages.append(t)
        for least in (1, 2, 3):
            want = bytearray(n)
            for a in range(n):
                for b in range(a + least, n + 1):
                    if any(t[c : c + b - a] == t[a:b] for c in range(n - b + a + 1) if c != a):
                        want[a:b] = b"\1" * (b - a)
            assert s.repeats(t, least) == want
        ids = np.array([ord(x) for x in t])
        far = [max([k for k in range(1, n + 1) for c in range(n) if c != i and max(i, c) + k <= n and t[i : i + k] == t[c : c + k]], default=0) for i in range(n)]
        assert s.longest(ids).tolist() == far
    together = s.repeats_of([np.array([ord(x) for x in t], dtype=np.int64) for t in pages])  # pages side by side repeat nothing of each other
    assert [x.tolist() for x in together] == [[bool(v) for v in s.repeats(t)] for t in pages]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, SPAM["keywords"]), (4, SPAM["keywords"]), (None, SPAM["links"]), (5, "cheap loan " * 100_000), (6, "x" * 300_000), (7, "퟿\x00")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"chars": F.lit("x"), "stuffing": F.lit(1)})
    assert sorted(str(r.doc_id) for r in s.stuffed(df).collect()) == ["4", "4", "5", "None"]
    assert s.measure(df, "doc_id", "text").count() == len(rows)
    assert s.stuffed(df.limit(0)).count() == 0
