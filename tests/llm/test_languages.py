"""Languages of held-out sentences: none of them is in the seeds."""

import pytest

from weftwork.llm import hidden_prose as HP
from weftwork.llm import language as LG

HELD_OUT = {
    "en": "Reads every record from the ledger and sorts them by date.", "de": "Diese Methode liest alle Datensätze aus der Datenbank und sortiert sie nach Datum.", "fr": "Cette méthode lit tous les enregistrements de la base et les trie par date.",
    "es": "Este método lee todos los registros de la base de datos y los ordena por fecha.", "pt": "Este método lê todos os registos da base de dados e ordena-os por data.", "it": "Questo metodo legge tutti i record dal database e li ordina per data.",
    "nl": "Deze methode leest alle records uit de database en sorteert ze op datum.", "pl": "Ta metoda odczytuje wszystkie rekordy z bazy danych i sortuje je według daty.", "ru": "Этот метод читает все записи из базы данных и сортирует их по дате.",
    "ja": "このメソッドはデータベースからすべてのレコードを読み込み、日付順に並べ替えます。", "zh": "该方法从数据库读取所有记录并按日期排序，然后返回结果。", "ko": "이 메서드는 데이터베이스의 모든 레코드를 읽고 날짜순으로 정렬합니다.",
    "sv": "Den här metoden hämtar alla poster från databasen och sorterar dem efter datum.", "tr": "Bu yöntem veritabanındaki bütün kayıtları okur ve tarihe göre sıralar.", "ar": "تقرأ هذه الدالة جميع السجلات من قاعدة البيانات وترتبها حسب التاريخ.",
    "uk": "Цей метод читає всі записи з бази даних та впорядковує їх за датою створення.", "hi": "यह विधि डेटाबेस से सभी रिकॉर्ड पढ़ती है और उन्हें तारीख के अनुसार क्रमबद्ध करती है।", "cs": "Tato metoda načte všechny záznamy z databáze a seřadí je podle data.",
    "fi": "Tämä menetelmä lukee kaikki tietueet tietokannasta ja järjestää ne päivämäärän mukaan.", "hu": "Ez a metódus beolvassa az összes rekordot az adatbázisból, és dátum szerint rendezi őket.", "ro": "Această metodă citește toate înregistrările din baza de date și le sortează după dată.",
    "el": "Αυτή η μέθοδος διαβάζει όλες τις εγγραφές από τη βάση δεδομένων και τις ταξινομεί.",
}
UNKNOWN = ["Šī metode nolasa visus ierakstus no datu bāzes un sakārto tos pēc datuma.", "Kazi hii inasoma rekodi zote kutoka kwenye hifadhidata na kuzipanga kwa tarehe.", "Metode ini membaca semua catatan dari basis data dan mengurutkannya menurut tanggal.",
           "Metodo honek datu-baseko erregistro guztiak irakurtzen ditu eta dataren arabera ordenatzen ditu.", "Phương thức này đọc tất cả các bản ghi từ cơ sở dữ liệu và sắp xếp chúng theo ngày."]


def found(text):
    return set(HP._phrases(HP._doc_text(text), LG.viterbi([HP._doc_text(text)])[0]))


@pytest.mark.parametrize("lang", sorted(HELD_OUT))
def test_held_out(lang):
    assert found(HELD_OUT[lang]) == {lang}


def test_other_languages_are_none_of_these():
    assert [s for s in UNKNOWN if found(s)] == []


def test_two_languages_in_a_record_and_marked_up_code():
    assert found(HELD_OUT["de"] + "\n\n" + HELD_OUT["pl"] + " " + HELD_OUT["en"]) == {"de", "pl", "en"}
    assert found("<code>" + "this is the text of a sample that should not be read at all " * 30 + "</code> ok") == set()
    assert found("<code> never closed. " + HELD_OUT["en"]) == {"en"}
    assert found("<" * 100_000 + HELD_OUT["fr"]) == {"fr"} and found("") == set()
