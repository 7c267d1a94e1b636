"""Word lists, limits and formats that results depend on.

Everything in this module is data, not logic. The lists are kept in the order in
which the rules consult them, because for several of them the first match wins.
"""

from decimal import Decimal

# --- Fixed values: sites ----------------------------------------------------
SITE_HOSTS = [
    ("hepsiburada", "hepsiburada"),
    ("trendyol", "trendyol"),
    ("network", "network"),
    ("beymenclub", "beymenclub"),
    ("bengurme", "bengurme"),
    ("nordbron", "nordbron"),
    ("zara", "zara"),
    ("hm.com", "hm"),
    ("amazon", "amazon"),
]
SITE_LABELS = {
    "amazon": "Amazon",
    "hepsiburada": "Hepsiburada",
    "trendyol": "Trendyol",
    "network": "Network",
    "beymenclub": "Beymen Club",
    "bengurme": "Ben Gurme",
    "nordbron": "Nordbron",
    "zara": "Zara",
    "hm": "H&M",
}
ERROR_SITE_FALLBACK = "Ürün kontrolü"
FASHION_SITES = ["zara", "hm"]
FASHION_GROUP = "Moda"
OTHER_GROUP = "Diğer"
SHARED_GROUP = "Paylaşılanlar"
STOCK_RETURN_SITES = ["bengurme"]
AMAZON_BASE = "https://www.amazon.com.tr"
LISTING_BASE = "https://www.hepsiburada.com"
LISTING_HOSTS = ["www.hepsiburada.com", "hepsiburada.com"]
REVIEW_PATH_WORDS = ["degerlendirme", "yorum", "review"]
VARIATION_PARAMS = ["smid", "psc", "th"]
SEARCH_PARAMS = ["__mk_tr_TR", "bbn", "dc", "field-keywords", "i", "k", "node", "rh", "srs", "url"]
QUERY_NAME_PARAMS = ["k", "q", "query", "search"]

# --- Fixed values: limits ---------------------------------------------------
WATCH_URL_FIELDS = ["url_1", "url_2", "url_3", "url_4", "url_5"]
SCAN_LIMIT = 60
SCAN_LIMIT_MAX = 100
DEFAULT_INTERVAL_SECONDS = 60
DAY_SECONDS = 86400
HOUR_SECONDS = 3600
SPIKE_RATIO = Decimal("5")
SPIKE_AMOUNT = Decimal("50000")
DROP_MIN_DELTA = 6
DROP_RATIO = 3
DROP_STREAK = 5
QUIET_FROM_HOUR = 22
QUIET_TO_HOUR = 8
FAILURE_MIN_PAGES = 4
FAILURE_MIN_LINKS = 6
ERROR_NOTICE_HOUR = 11
SEEN_MESSAGES = 5000
REPLY_HOURS = 24
RECENT_NOTIFICATIONS = 5
LISTING_MIN_PRICE = Decimal("50")
LISTING_MAX_PRICE = Decimal("1000000")
REFERENCE_FLOOR_RATIO = Decimal("0.50")
PURGE_VERSION = 4
BLOCK_STATUS = [429, 503]

# --- Fixed values: texts ----------------------------------------------------
TRUE_WORDS = ["1", "true", "yes", "on", "evet"]
MOJIBAKE_MARKS = ["Ã", "Ä", "Å", "Â", "�"]
NO_ERROR_DETAIL = "Hata ayrıntısı kaydedilmemiş."
NO_KEYWORD = "Aranan keyword belirtilmemiş"
ONE_KEYWORD = "Aranan keyword"
MANY_KEYWORDS = "Aranan keywordler"
DEFAULT_CHANNELS = [
    "@yaniyocom",
    "@firsatz",
    "@onual_firsat",
    "@onual_ekstra",
    "@butcedostu",
    "@depoindirim",
    "@uygunfiyatdedektifi",
    "@tasarrufluharca",
    "@depourunleri",
    "@evEkonomi",
    "@firsatavi",
]
KEYWORD_ALERT_TITLE = "Telegram keyword alarmı"

# --- Fixed values: page gates -----------------------------------------------
AGE_WORDS = ["yas dogrulamasi", "18 yasindan buyuk musunuz"]
BOT_WORDS = {
    "hm": [
        "access denied",
        "sec-if-cpt",
        "you don't have permission to access",
        "akamai bot manager",
        "akamai security",
    ],
    "hepsiburada": ["hepsiburada guvenlik", "hbblockandcaptcha", "static hepsiburada net security"],
}
AMAZON_PROTECTION_WORDS = [
    "captcha",
    "automated access",
    "robot check",
    "not a robot",
    "robot olmadiginizi",
    "enter the characters you see below",
]
AMAZON_SEARCH_PAGE_WORDS = ["s-search-result", 'data-cy="title-recipe"', "data-cy='title-recipe'",
                            "puis-card-container", "/dp/", "/gp/product/"]
MISSING_PRICE_WORDS = ["fiyat bulunamadi", "okunabilir fiyat bulunamadi", "fiyat yakalanamadi", "stokta degil"]
EMPTY_SEARCH_WORDS = [
    "amazon arama sayfasinda urun adina uyan fiyatli urun bulunamadi",
    "amazon arama sayfasinda okunabilir fiyat bulunamadi",
]
BLOCK_KEY_WORDS = ["captcha", "robot", "bot_korumasi", "koruma_sayfasi"]
SEARCH_STOP_HEADINGS = [
    "all departments icindeki sonuclar",
    "yardima mi ihtiyaciniz var",
    "baktiginiz urunlere gore belirlenen urunler",
    "tarama gecmisinizdeki urunleri goruntuleyen musteriler ayrica sunlari da goruntuledi",
]

# --- Fixed values: sizes and stock ------------------------------------------
SIZE_UNIT_WORDS = ["eu", "us", "uk", "yas", "yil", "beden", "size"]
SOLD_OUT_WORDS = [
    "outofstock",
    "out of stock",
    "sold out",
    "unavailable",
    "not available",
    "disabled",
    "stokta yok",
    "tukendi",
    "benzer urunler",
]
SOLD_OUT_EXACT = ["false", "0", "outofstock", "soldout", "unavailable"]
ZARA_SOLD_OUT_WORDS = ["outofstock", "discontinued", "benzer urunler"]
BENGURME_SOLD_OUT_WORDS = ["tukendi", "sold out", "outofstock", "out of stock"]
SIZE_FIELDS = ["size", "sizename", "sizevalue", "beden", "bedenadi"]
STOCK_FIELDS = ["available", "instock", "isavailable", "stock", "stocklevel", "quantity", "availability"]
SIZE_CONTEXT_WORDS = ["size", "beden", "variant", "varyant", "option", "secenek"]
SIZE_TAGS = ["button", "option", "label", "li", "a", "input"]
DEFAULT_VARIANT_NAMES = ["default title", "varsayilan baslik"]

# --- Fixed values: listing texts --------------------------------------------
INSTALMENT_WORDS = ["pesin fiyatina", "taksit", " x "]
COUPON_WORDS = ["kupon", "hepsipara", "kazan"]
CART_WORDS = ["sepete özel", "sepete ozel"]
MEMBER_WORDS = [
    "premium ile",
    "premium'a özel fiyat",
    "premium'a ozel fiyat",
    "premiuma özel fiyat",
    "premiuma ozel fiyat",
    "premium özel fiyat",
    "premium ozel fiyat",
]
CAMPAIGN_WORDS = ["indirim", "kazanc", "kazancimi", "hepsipara", "kupon", "koruma paketi", "paketlerinde"]
BLOCKED_PRICE_WORDS = ["installment", "taksit", "aylik", "worldcard", "kupon", "coupon", "kargo", "cargo",
                       "shipping", "shipment"]
REFERENCE_PRICE_NAMES = ["finalpriceonsale", "finalprice", "final price", "saleprice", "sale price", "currentprice",
                         "current price", "discountedprice", "discounted price"]
BAD_TITLE_WORDS = ["teslimat bilgisi", "sepete ekle", "kampanya", "peşin fiyatına", "pesin fiyatina", "fiyat:"]
DETAIL_STOP_WORDS = ["urun bilgileri", "urun aciklamasi", "degerlendirmeler"]
BRANDS = ["apple", "samsung", "govee", "philips", "tapo", "xiaomi", "huawei", "lenovo", "asus", "acer", "lg", "sony",
          "anker", "roborock", "dyson", "bosch", "siemens"]
VARIANT_FIELDS = ["renk", "kapasite", "hafiza", "depolama", "dahili hafiza", "ram", "beden", "boyut", "numara",
                  "secenek"]
VARIANT_FORBIDDEN = ["non segmented price", "segmented price", "minimum price", "final price", "merchant",
                     "merchant name", "listing", "listing id"]
VARIANT_NOISE_WORDS = ["fiyat", "price", "taksit", "sepete", "teslimat", "merchant", "listing"]
VARIANT_CUT_WORDS = ["Satıcı", "Satici", "Sepete", "Adet", "Teslimat", "Ürün", "Urun", "Kuponlar"]
VARIANT_CONTEXT_WORDS = ["variant", "varyant", "renk", "color", "secenek"]
COLOURS = [
    ("antrasit", "Antrasit"),
    ("lacivert", "Lacivert"),
    ("mint yesili", "Mint Yeşili"),
    ("gumus", "Gümüş"),
    ("gri", "Gri"),
    ("mavi", "Mavi"),
    ("siyah", "Siyah"),
    ("beyaz", "Beyaz"),
    ("yesil", "Yeşil"),
    ("kirmizi", "Kırmızı"),
    ("pembe", "Pembe"),
    ("mor", "Mor"),
    ("sari", "Sarı"),
    ("turuncu", "Turuncu"),
    ("bej", "Bej"),
]
DEFAULT_SELLER = "Hepsiburada"

# --- Fixed values: price sources of a page ----------------------------------
PRICE_META = [
    ("property", "product:price:amount"),
    ("property", "og:price:amount"),
    ("itemprop", "price"),
    ("name", "twitter:data1"),
]
OFFER_PRICE_KEYS = ["price", "lowPrice", "highPrice", "priceAmount"]
SCRIPT_PRICE_PATTERNS = [
    r'(?i)"(?:price|sellingPrice|discountedPrice|currentPrice|amount)"\s*:\s*"?(\d+(?:[.,]\d{1,2})?)"?',
    r"(?i)(\d{1,3}(?:\.\d{3})*,\d{2})\s*TL",
]
BASKET_PRICE = r"((?:\d{1,3}(?:\.\d{3})+(?:,\d{2})?|\d+(?:,\d{2})?))"
BASKET_PATTERNS = [
    r"(?is)(?<!\d)\d+\s*ve\s*(?:üzeri|uzeri)(?:\s+adet)?(?:\s+(?:için|icin))?\s*" + BASKET_PRICE + r"\s*tl",
    r"(?is)\d+\s*ve\s*(?:üzeri|uzeri|ve\s*üzeri|ve\s*uzeri).*?sepette\s*" + BASKET_PRICE + r"\s*tl",
    r"(?is)sepette\s*" + BASKET_PRICE + r"\s*tl",
]
LISTING_PRICE_PATTERN = r"(?i)(?<![\d.,])((?:\d{1,3}(?:\.\d{3})+|\d{1,7})(?:,\d{2})?\s*TL)"
LISTING_PRICE_LIKE_PATTERN = r"(?<![\d.,])((?:\d{1,3}(?:\.\d{3})+|\d{4,7})(?:,\d{2})?)(?![\d.,])"
TEXT_PRICE_PATTERN = r"(\d{1,3}(?:\.\d{3})*,\d{2})\s*TL"
HM_TEXT_PRICE_PATTERN = r"(?i)(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)\s*(?:TL|₺)"
LISTING_URL_PATTERN = r"(?i)/(?:[^\s'\"<>]+)-(?:p|pm)-[A-Z0-9]+"
NO_TRADE_IN_PATTERN = (r"(?:degis\s+tokus|takas)\s+olmadan\s+"
                       r"(\d{1,3}(?:\.\d{3})+|\d+)(?:,(\d{1,2})|\s*(\d{2}))?\s*tl")
LOW_STOCK_PATTERN = r"stokta\s+sadece\s+(\d+)\s+adet\s+kaldi"
USED_PRICE_PATTERN = r"diger\s+satin\s+alma\s+secenekleri\s+(\d{1,3}(?:\.\d{3})*,\d{2}|\d+(?:,\d{2})?)\s*tl"

# --- health messages: fixed values ------------------------------------------
SUMMARY_WARNING = "özet uyarısı"
SUMMARY_WARNING_LINES = [
    "Özet tablodaki ürün sayısı 5 ardışık tur boyunca beklenenden fazla düştü.",
    "Beklenen ürün sayısı: {expected}",
    "Bu tur bulunan ürün sayısı: {found}",
    "Fark: -{missing}",
    "Config'i, özellikle Amazon arama linklerini kontrol etmeni öneririm. "
    "Amazon arama linkleri geçici olarak boş veya eksik dönmüş olabilir.",
]
SEARCH_WARNING = "arama erişim uyarısı"
SEARCH_WARNING_LINES = [
    "Arama sayfalarinda anlamli sayida erisim hatasi yakalandi.",
    "Etkilenen arama sayfasi: {pages}",
    "Hata veren link sayisi: {links}",
    "Bos arama sonuclari bu uyarinin disindadir. Erisim, koruma veya sayfa hatasi olan linkleri kontrol etmeni oneririm.",
]
MESSAGE_LIMIT = 900
