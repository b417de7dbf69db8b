"""Patterns, word lists, weights and formats that results must agree with."""

#: (name, confidence, pattern, flags) in the order in which ties are decided.
QUESTION_PATTERNS = [
    ("標準問題形式", 0.95, r"^(?:問題?|問)\s*(\d+)[．.\s]*([^問]+?)(?=問\s*\d+|$)", "s"),
    ("第N問形式", 0.90, r"^第\s*(\d+)\s*問[．.\s]*([^第]+?)(?=第\s*\d+\s*問|$)", "s"),
    ("番号のみ形式", 0.80, r"^(\d+)[．.\)\s]+(.+?)(?=\d+[．.\)\s]|$)", "s"),
    ("括弧番号形式", 0.85, r"^\((\d+)\)\s*(.+?)(?=\(\d+\)|$)", "s"),
    ("四角括弧形式", 0.90, r"^【(\d+)】\s*(.+?)(?=【\d+】|$)", "s"),
    ("Q番号形式", 0.75, r"^Q[．.\s]*(\d+)[．.\s]*(.+?)(?=Q[．.\s]*\d+|$)", "s"),
    ("宅建形式1", 0.85, r"^(\d+)[\s　]*[．.。][\s　]*(.+?)(?=\d+[\s　]*[．.。]|$)", "s"),
    ("宅建形式2", 0.85, r"^(\d+)[\s　]*[:：][\s　]*(.+?)(?=\d+[\s　]*[:：]|$)", "s"),
    ("5桁問題番号", 0.90, r"^(\d{4,6})(.+?)(?=\d{4,6}|$)", "s"),
    ("宅建年度番号形式", 0.95, r"^(\d{5})(.+?)(?=×|〇|○|解説|答え|^[\s]*\d{5}|$)", "s"),
    ("複数行対応5桁", 0.90, r"(\d{5})([\s\S]+?)(?=\d{5}|×|〇|○|$)", "s"),
    ("回答アンカー形式", 0.95, r"(\d{5})([\s\S]*?)([×〇○])", "s"),
    ("DOTALL複数行", 0.92, r"(\d{5})(.+?)([×〇○])", "si"),
    ("シンプル数字", 0.70, r"^(\d+)[\s　]+(.+?)(?=^\d+[\s　]|$)", "s"),
    ("数字開始宅建形式", 0.90, r"^(\d{3,4})\s+(.+?)(?=^\d{3,4}\s|$)", "sm"),
]
#: The pattern that never yields a valid row in the adaptive choice (its text group is a year) and backtracks without
#: bound; the answer-aware detector works off its meaning in bounded segments instead.
COMPLETE_PATTERN = ("問題番号→年度→問題→回答", 0.98)
SIMPLE_NUMBER_PATTERNS = [
    r"^(\d+)[\s\.\)：。]+(.+)?",
    r"^問\s*(\d+)[\s\.\)：。]*(.+)?",
    r"^第?\s*(\d+)\s*問[\s\.\)：。]*(.+)?",
    r"^\[(\d+)\][\s\.\)：。]*(.+)?",
    r"^【(\d+)】[\s\.\)：。]*(.+)?",
    r"^(\d{4,6})(.+)?",
    r"^(\d{5})\s*(.+)?",
]
EMERGENCY_PATTERNS = [r"^(\d+)[\.．。\s]", r"^(\d+)\)", r"^\((\d+)\)", r"^(\d+):", r"^(\d+)\s+"]
#: (name, confidence, type, pattern); case is ignored.
ANSWER_PATTERNS = [
    ("○×答え", 0.95, "correct_incorrect", r"(?:答え?|解答|正解|A|Answer)[:：]?\s*([〇○×])"),
    ("単独○×", 0.85, "correct_incorrect", r"^([〇○×])\s*$"),
    ("選択肢番号答え", 0.90, "multiple_choice", r"(?:答え?|解答|正解)[:：]?\s*([①②③④⑤1-5アイウエオ])"),
    ("文中答え", 0.70, "in_text", r"([〇○×①②③④⑤1-5])\s*(?:が正解|が正しい|が誤り)"),
]
EXPLANATION_PATTERNS = [r"^(?:解説|説明|補足|理由|根拠)[:：]?\s*(.+)", r"^(?:ポイント|要点)[:：]?\s*(.+)"]
#: (name, confidence, pattern with the text as its last group).
CHOICE_PATTERNS = [
    ("丸数字選択肢", 0.95, None),
    ("数字選択肢", 0.90, r"^[1-9]\.\s*(.+?)(?=^[1-9]\.|$)"),
    ("アイウエ選択肢", 0.85, r"^[アイウエオカキクケコ]\.\s*(.+?)(?=^[アイウエオカキクケコ]\.|$)"),
    ("括弧数字選択肢", 0.80, r"^\(([1-9])\)\s*(.+?)(?=^\([1-9]\)|$)"),
]
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
KATAKANA_NUMBERS = "アイウエオ"

ENCODING_FIXES = [("???", ""), ("?", ""), ("・・・", "…"), ("　　", "　"), ("\0", ""), ("\uFFFD", "")]
NORMALIZATIONS = [("～", "〜"), ("·", "・"), ("○", "〇")]
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
FULL_DIGITS, HALF_DIGITS = "０１２３４５６７８９", "0123456789"
POSITIVE_KEYWORDS = ["正しい", "適切", "可能", "できる", "必要", "義務", "有効"]
NEGATIVE_KEYWORDS = ["誤っている", "不適切", "不可能", "できない", "不要", "禁止", "無効"]

OTHER_SECTION = "その他"
#: (name, keywords, first and last question number).
SECTIONS = [
    ("権利関係", ["民法", "不動産登記法", "借地借家法", "区分所有法", "契約", "物権", "債権"], (1, 100)),
    ("宅建業法", ["宅建業", "免許", "宅地建物取引士", "重要事項説明", "37条書面"], (101, 150)),
    ("法令上の制限", ["都市計画法", "建築基準法", "国土利用計画法", "農地法", "土地区画整理法"], (151, 200)),
    ("税・その他", ["不動産取得税", "固定資産税", "所得税", "印紙税", "地価公示"], (201, 250)),
]
#: section -> (text for 〇, text for ×); others take the last.
EXPLANATIONS = {
    "権利関係": ("民法および関連法の規定により、この記述は正しいです。権利関係の基本的な理解を深めることが重要です。", "民法および関連法の規定により、この記述は誤りです。正しい法律関係を確認しましょう。"),
    "宅建業法": ("宅建業法の規定により、この記述は正しいです。宅建業者の義務や制限について正確に理解しましょう。", "宅建業法の規定により、この記述は誤りです。宅建業法の正しい内容を確認することが重要です。"),
    "法令上の制限": ("法令上の制限に関する規定により、この記述は正しいです。各種法令の制限内容を正確に把握しましょう。", "法令上の制限に関する規定により、この記述は誤りです。関連する法令の正しい制限内容を確認しましょう。"),
    "税・その他": ("税法およびその他の関連法令により、この記述は正しいです。不動産に関する税制の理解を深めましょう。", "税法およびその他の関連法令により、この記述は誤りです。正しい税制や評価方法を確認しましょう。"),
}
EXPLANATION_HINTS = [
    ("契約", " 契約の成立要件や効力について詳しく学習することをお勧めします。"),
    ("登記", " 不動産登記法の仕組みと手続きについて理解を深めましょう。"),
    ("免許", " 免許制度の詳細と更新手続きについて確認しておきましょう。"),
    ("重要事項", " 重要事項説明書の記載事項と説明義務について復習しましょう。"),
]
QUALITY_WEIGHTS = {"question_length": 0.25, "choice_count": 0.20, "choice_quality": 0.15, "answer_presence": 0.20, "explanation_quality": 0.10, "format_consistency": 0.10}
DEFAULT_YEAR = "R6"
MAX_NUMBER = 99999
MIN_PATTERN_SCORE = 20
MAX_FILE_BYTES = 100 * 1024 * 1024
PREVIEW_ROWS = 20
#: Records of low confidence that a report shows, the confidence below which they count, and their excerpts' length.
ATTENTION_ROWS, ATTENTION_BELOW, EXCERPT = 10, 70, 50
UNKNOWN_ERROR = "不明なエラー"
#: Patterns of cleaning: a number and marks that lead a question, words and marks that lead an explanation, runs of a character.
LEADING_NUMBER = r"^(?:問題?|第|Q|No\.?|【|〔|\()?(\d+)(?:問|】|〕|\)|\.|\s)?\s*"
LEADING_MARKS = r"^[　\s]*[・●○▲△□■◆]+[　\s]*"
LEADING_EXPLANATION = r"^(?:解説|説明|補足|理由|根拠)[:：]?\s*"
LEADING_NOTE = r"^[　\s]*[※注意]"
RUN = r"(.)\1{4,}"
JAPANESE_LETTERS = "[あ-んア-ヶ一-龠]"
#: Lines that say nothing: digits, glyphs, headers and footers alone, or fewer characters than this; the hierarchy parser's own list.
IGNORABLE_BELOW = 3
IGNORABLE = [r"^\d+$", r"^[・●○▲△□■◆\-=]+$", r"^(ページ|Page|\d+\/\d+|第\d+章)"]
HIER_IGNORABLE = [r"^\d+$", r"^[・●○▲△□■◆\-=\s]+$", r"^(ページ|Page|\d+/\d+|第\d+章)", "^表[①②③④⑤]"]
#: Number, text and mark of a printed record.
ANCHORED = r"(\d{5})([\s\S]*?)([×〇○])"
CSV_HEADERS = ["問題ID", "セクション", "年度", "問題番号", "問題文", "答え", "解説", "ソースファイル", "抽出方法", "信頼度", "作成日時"]
HIERARCHY_HEADERS = ["大項目", "中項目", "小項目", "最小項目", "問題番号", "出題年度", "問題", "解説", "回答"]

#: Level -> patterns, searched in this order without case.
HIERARCHY_PATTERNS = [
    ("大項目", [r"第[一二三四五六七八九十０-９0-9]+章\s*[：:]\s*(.+)", r"[第]?[一二三四五六七八九十０-９0-9]+\s*[章編部]\s*[：:]?\s*(.+)", r"宅建業法|権利関係|税・その他|法令上の制限"]),
    ("中項目", [r"Section\s*[０-９0-9]+\s*(.+)", r"第[０-９0-9一二三四五六七八九十]+節\s*(.+)", r"[０-９0-9]+[．.]\s*(.+)", r"■\s*(.+)"]),
    ("小項目", [r"[０-９0-9一二三四五六七八九十]+[｜|]\s*(.+)", r"[０-９0-9]+[-－]\s*(.+)", r"●\s*(.+)"]),
    ("最小項目", [r"[０-９0-9]+-[０-９0-9]+\s*(.+)", r"[０-９0-9]+\.\s*[０-９0-9]+\s*(.+)", r"▶\s*(.+)"]),
]
HIER_QUESTION_PATTERNS = [
    r"^([０-９0-9]+)[．.。：:\s]+(.+)",
    r"^問\s*([０-９0-9]+)[．.。：:\s]*(.+)",
    r"^第?\s*([０-９0-9]+)\s*問[．.。：:\s]*(.+)",
    r"^\[([０-９0-9]+)\][．.。：:\s]*(.+)",
    r"^【([０-９0-9]+)】[．.。：:\s]*(.+)",
    r"^([０-９0-9]+)\s*[\)\）][．.。：:\s]*(.+)",
]
HIER_ANSWER_PATTERNS = [r"^[答回正解][：:]\s*([○×〇])", r"^[答回正解]\s*([○×〇])", r"^([○×〇])\s*$", r"答え?[：:]?\s*([○×〇])", r"正解[：:]?\s*([○×〇])"]
#: (kind, pattern).
HIER_YEAR_PATTERNS = [("R", r"[Rr]([0-9０-９]+)"), ("R", r"令和([0-9０-９]+)"), ("H", r"[Hh]([0-9０-９]+)"), ("H", r"平成([0-9０-９]+)"), ("年", r"([0-9０-９]+)年"), ("20", r"20([0-9０-９]{2})")]
HIER_KEEP = r"[^\w\s\n\r\t。、．，：；！？「」『』（）〈〉【】○×〇▲△□■◆●・\-=]"
#: Byte-order mark that opens a CSV file.
BOM = "\uFEFF"
#: What an export is named before its day.
EXPORT_NAME = "宅建問題集"
