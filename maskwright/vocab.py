"""Rules as data: character classes, patterns and word lists of the masking decisions."""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on them.
JS_SPACE = "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
#: The same characters as themselves.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WIDE = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９＠"
NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@"
EMAIL_TAIL = "@[a-z0-9-]+(?:\\.[a-z0-9-]+)+"
EMAIL_HEAD = "[a-z0-9]+(?:[._%+-][a-z0-9]+){2,}@?"
EMAIL = "[a-z0-9][a-z0-9._%+-]*@[a-z0-9-]+(?:\\.[a-z0-9-]+)+"
DIGIT_RUN = "[〒(（+＋]?[0-9][0-9\\-‐‑–—−ー－()（）.,／．，/+#]*[0-9][)）]?"
METRIC = "[+\\-±−＋－]?[0-9]{1,3}(?:,[0-9]{3})*(?:\\.[0-9]+)?(?:%|％|ms|件|人|回|分|秒)"
METRIC_BEFORE = "(?<![0-9.,\\-‐‑–—−ー－()（）．，／/+＋#:：〒@])"
PHRASE_DROP = JS_SPACE + ":：;；,，.。、()（）\\[\\]「」【】"
NAME_LIKE = "^[ぁ-ゖァ-ヺー一-鿿々]{1,4}$"
ASCII_WORD = "^[A-Za-z][A-Za-z.'-]*$"
ADDRESS_SUFFIX = ("都", "道", "府", "県", "市", "区", "町", "村", "郡")
LONG_TEXT, NOISE_CONFIDENCE, MASK_PADDING = 8, 35, 3
KANJI, KANA_NAME = "^[一-鿿々]+$", "^[ぁ-ゖー]{1,4}$"
KANJI_DETAILS, KANA_DETAILS = ("一般", "固有名詞", "サ変接続"), ("一般", "固有名詞")

#: In this order; of patterns that cover a unit the last one names the reason.
LINE_PATTERNS = (("email-frag", EMAIL_TAIL), ("email-frag", EMAIL_HEAD), ("email", EMAIL), ("digit-run", DIGIT_RUN))

#: The initial dictionary of interface labels, normalized; runs extend it by ``Rules.labels``.
LABELS = (
    "保存", "検索", "一覧", "編集", "削除", "新規", "登録", "更新", "追加", "戻る", "次へ", "前へ", "閉じる", "開く", "送信", "確認", "確定", "取消", "キャンセル", "ログイン", "ログアウト", "設定", "ヘルプ",
    "メニュー", "ホーム", "詳細", "表示", "非表示", "選択", "解除", "絞り込み", "並び替え", "出力", "印刷", "複製", "承認", "却下", "申請", "完了", "未完了", "新規登録", "新規作成", "詳細表示", "一括操作", "絞り込む",
    "氏名", "名前", "住所", "電話", "電話番号", "番号", "メール", "メールアドレス", "アドレス", "顧客", "顧客名", "会社", "会社名", "部署", "担当", "担当者", "状態", "日付", "金額", "備考", "操作", "件名", "内容",
    "種別", "区分", "管理", "システム", "画面", "ログイン中", "契約", "save", "search", "edit", "delete", "new", "add", "back", "next", "close", "open", "submit", "cancel",
    "login", "logout", "settings", "help", "menu", "home", "detail", "details", "list", "view", "select", "name", "email", "address", "phone", "status",
    "date", "amount", "action", "actions", "filter", "sort", "export", "print", "note", "import", "refresh", "reload", "reset", "apply", "clear", "retry",
    "continue", "skip", "finish", "start", "stop", "pause", "resume", "sync", "sync status", "bulk", "bulk actions", "overview", "summary",
    "account overview", "dashboard", "report", "reports", "analytics", "last modified", "modified", "owner", "role", "owner role", "access",
    "access level", "subscription", "subscription plan", "plan", "download", "upload", "archive", "draft", "published", "active", "inactive", "enabled",
    "disabled", "pending", "preview", "duplicate", "copy", "paste", "undo", "redo", "loading", "error", "warning", "success", "info", "notification",
    "notifications", "profile", "account", "accounts", "user", "users", "admin", "administrator", "history", "recent", "favorite", "favorites",
    "bookmark", "bookmarks", "tag", "tags", "category", "categories", "group", "groups", "team", "teams", "csv", "pdf", "ok", "id", "no", "fax", "url",
    "エクスポート", "インポート", "リフレッシュ", "ダッシュボード", "csvエクスポート", "csvインポート", "アクティブ",
)


@dataclass(frozen=True)
class Rules:
    """What a run may change: ``terms`` are phrases that are never masked, ``labels`` interface labels, ``noise`` the
    least confidence, ``scale`` the enlargement at which boxes were read, ``padding`` what a mask adds on each side."""

    terms: tuple[str, ...] = ()
    labels: tuple[str, ...] = LABELS
    noise: int = NOISE_CONFIDENCE
    scale: float = 1.0
    padding: float = MASK_PADDING
