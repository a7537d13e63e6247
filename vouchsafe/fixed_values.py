"""Texts, codes and tables that results must carry verbatim."""

from __future__ import annotations

# --- fixed values: enumerations ---------------------------------------------
DOCUMENT_TYPES = (
    "payment_invoice",
    "vat_invoice",
    "universal_transfer_document",
    "consignment_note_torg12",
    "work_completion_act",
)
DOCUMENT_STATUSES = ("uploaded", "processing", "extracted", "review_required", "completed", "failed")
OPEN_TASK_STATUSES = ("pending", "in_progress")
SOURCE_KINDS = ("pdf_text", "ocr", "image", "spreadsheet")
RULES = (
    "total_mismatch",
    "vat_rate_mismatch",
    "invalid_inn",
    "same_parties",
    "document_date_out_of_range",
    "low_confidence",
)
BLOCKING_RULES = ("total_mismatch", "vat_rate_mismatch", "same_parties")

# --- fixed values: labels ----------------------------------------------------
FIELD_LABELS = {
    "document_type": "Тип документа",
    "number": "Номер",
    "date": "Дата документа",
    "total_amount": "Итого",
    "vat_amount": "НДС",
    "currency": "Валюта",
    "supplier/name": "Поставщик",
    "supplier/inn": "ИНН поставщика",
    "supplier/kpp": "КПП поставщика",
    "buyer/name": "Покупатель",
    "buyer/inn": "ИНН покупателя",
    "buyer/kpp": "КПП покупателя",
    "payment_due_date": "Срок оплаты",
    "correction_number": "Номер исправления",
    "correction_date": "Дата исправления",
    "upd_status": "Статус УПД",
    "operation_name": "Содержание операции",
    "shipment_date": "Дата отгрузки",
    "basis_document": "Основание",
    "contract_number": "Номер договора",
    "contract_date": "Дата договора",
    "service_period_start": "Период услуг, начало",
    "service_period_end": "Период услуг, конец",
}
RULE_LABELS = {
    "total_mismatch": "Итог не сходится с позициями",
    "vat_rate_mismatch": "НДС не сходится со ставкой",
    "invalid_inn": "ИНН не проходит проверку",
    "same_parties": "Поставщик и покупатель совпадают",
    "document_date_out_of_range": "Дата документа вне диапазона",
    "low_confidence": "Низкая уверенность модели",
}
TYPE_LABELS = {
    "payment_invoice": "Счёт на оплату",
    "vat_invoice": "Счёт-фактура",
    "universal_transfer_document": "УПД",
    "consignment_note_torg12": "ТОРГ-12",
    "work_completion_act": "Акт выполненных работ",
}

# --- fixed values: currency aliases -----------------------------------------
CURRENCY_ALIASES = {
    "руб.": "RUB",
    "руб": "RUB",
    "₽": "RUB",
    "российский рубль": "RUB",
    "российские рубли": "RUB",
    "rur": "RUB",
    "rub": "RUB",
    "usd": "USD",
    "$": "USD",
    "евро": "EUR",
    "eur": "EUR",
}

# --- fixed values: tax number checksum weights ------------------------------
INN10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_FIRST_WEIGHTS = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_SECOND_WEIGHTS = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)

# --- fixed values: file types and signatures (hex) --------------------------
SUFFIX_TYPES = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
}
SUFFIX_SIGNATURES = {
    "255044462D": ".pdf",
    "89504E470D0A1A0A": ".png",
    "FFD8FF": ".jpg",
    "49492A00": ".tif",
    "4D4D002A": ".tif",
}
DECLARED_SIGNATURES = {
    "application/pdf": ("255044462D",),
    "application/vnd.ms-excel": ("D0CF11E0A1B11AE1",),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ("504B0304",),
    "image/jpeg": ("FFD8FF",),
    "image/png": ("89504E470D0A1A0A",),
    "image/tiff": ("49492A00", "4D4D002A"),
    "image/webp": ("52494646........57454250",),
}
SPREADSHEET_TYPES = (
    "text/csv",
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
)
DOCUMENT_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".csv", ".xls", ".xlsx")

# --- fixed values: rule messages --------------------------------------------
MESSAGE_TOTAL = "Итог не равен сумме позиций до НДС плюс НДС с допустимым отклонением "
MESSAGE_RATE = "Допустимы ставки НДС 0, 10, 20 процентов или without_vat"
EXPECTED_RATES = "0|10|20|without_vat"
MESSAGE_LINE_VAT = "НДС позиции не соответствует сумме и заявленной ставке"
MESSAGE_DOCUMENT_VAT = "НДС документа не равен сумме НДС по позициям"
MESSAGE_INN = "ИНН не прошёл проверку контрольной суммы"
MESSAGE_PARTIES = "Поставщик и покупатель определены как одно лицо"
EXPECTED_PARTIES = "разные контрагенты"
SAME_INN = "совпадение ИНН"
SAME_NAME = "совпадение наименования"
MESSAGE_DATE = "Дата документа находится вне настроенного разумного диапазона"
MESSAGE_CONFIDENCE = "Уверенность поля ниже порога "

# --- fixed values: review texts ---------------------------------------------
MANUAL_REASON = "manual_correction: исправлено при ручной проверке"
MANUAL_PREFIX = "manual_correction"
MANUAL_SOURCE = "Подтверждено при ручной проверке"
COMMENT_PASSED = "Проверка пройдена после изменения данных"
COMMENT_CONFIRMED = "Проверено и подтверждено пользователем"
CONFIRMATION_PATH = "/review_completion"
CONFIRMATION_REASON = "manual_confirmation: Данные сверены с исходным документом"
CONFIRMATION_ORIGINAL = "issues_confirmed"

# --- fixed values: evidence text clean-up -----------------------------------
EVIDENCE_QUOTES = "«»“”„‘’\"'"
EVIDENCE_DASHES = "‐‑‒–—−"

# --- fixed values: evaluated fields -----------------------------------------
EVAL_SCALARS = (
    "document_type", "number", "date", "total_amount", "vat_amount", "currency",
    "supplier.name", "supplier.inn", "supplier.kpp", "buyer.name", "buyer.inn", "buyer.kpp",
)
EVAL_LINE_FIELDS = ("name", "quantity", "unit", "unit_price", "amount", "vat_rate", "vat_amount")
NAME_PATHS = ("supplier.name", "buyer.name", "line_items[].name")
DECIMAL_PATHS = (
    "total_amount", "vat_amount", "line_items[].quantity", "line_items[].unit_price",
    "line_items[].amount", "line_items[].vat_rate", "line_items[].vat_amount",
)
DATE_PATHS = ("date",)
LINE_WEIGHTS = {
    "name": 0.50, "amount": 0.20, "quantity": 0.10, "unit_price": 0.10, "unit": 0.05, "vat_rate": 0.05,
}

# --- fixed values: names of line values that exports understand, first wins ----
LINE_NAMES = {
    "name": ("name",), "unit": ("unit", "unit_name"), "quantity": ("quantity", "qty"), "unit_price": ("unit_price", "price"),
    "amount": ("amount", "subtotal"), "vat_rate": ("vat_rate",), "vat_amount": ("vat_amount",), "total": ("total", "total_amount"),
}

# --- fixed values: dashboard queues -----------------------------------------
QUEUES = {
    "Нужно проверить": ("review_required",),
    "В обработке": ("uploaded", "processing", "extracted"),
    "Готово": ("completed",),
    "Ошибки": ("failed",),
}

# --- fixed values: Russian dates and numerals -------------------------------
MONTHS_GENITIVE = (
    "января", "февраля", "марта", "апреля", "мая", "июня",
    "июля", "августа", "сентября", "октября", "ноября", "декабря",
)
UNITS_MASCULINE = ("", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять")
UNITS_FEMININE = ("", "одна", "две", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять")
TEENS = (
    "десять", "одиннадцать", "двенадцать", "тринадцать", "четырнадцать", "пятнадцать",
    "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать",
)
TENS = ("", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто")
HUNDREDS = ("", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот")
SCALES = (
    ("тысяча", "тысячи", "тысяч"),
    ("миллион", "миллиона", "миллионов"),
    ("миллиард", "миллиарда", "миллиардов"),
)
ZERO_WORD = "ноль"

# --- fixed values: export texts ---------------------------------------------
EXPORT_FIELD_LABELS = {
    "/date": "Дата документа",
    "/buyer/inn": "ИНН покупателя",
    "/buyer/kpp": "КПП покупателя",
    "/buyer/name": "Покупатель",
    "/number": "Номер",
    "/currency": "Валюта",
    "/supplier/inn": "ИНН поставщика",
    "/supplier/kpp": "КПП поставщика",
    "/supplier/name": "Поставщик",
    "/vat_amount": "НДС",
    "/total_amount": "Итого",
    "/document_type": "Тип документа",
}
EXPORT_TYPE_LABELS = {
    "payment_invoice": "Счёт на оплату",
    "invoice": "Счёт",
    "act": "Акт",
    "contract": "Договор",
}
EXPORT_DEFAULT_TYPE = "Счёт на оплату"
WITHOUT_VAT_LABEL = "без НДС"
CHANGED_LABEL = "Исправлено"
UNCHANGED_LABEL = "Без изменений"
PASSED_LABEL = "Пройдено"
ATTENTION_LABEL = "Требует внимания"
