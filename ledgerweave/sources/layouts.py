"""Layouts of the budget-review files: what their names and header rows must be."""

from __future__ import annotations

#: File names of all groups; the year says nothing about when they were fetched.
FILES = {
    "organization": "1-1_RS_{year}_基本情報_組織情報",
    "summary": "1-2_RS_{year}_基本情報_事業概要等",
    "law": "1-3_RS_{year}_基本情報_政策・施策、法令等",
    "subsidy": "1-4_RS_{year}_基本情報_補助率等",
    "related": "1-5_RS_{year}_基本情報_関連事業",
    "budget": "2-1_RS_{year}_予算・執行_サマリ",
    "budget_detail": "2-2_RS_{year}_予算・執行_予算種別・歳出予算項目",
    "result": "3-1_RS_{year}_効果発現経路_目標・実績",
    "result_connection": "3-2_RS_{year}_効果発現経路_目標のつながり",
    "inspection": "4-1_RS_{year}_点検・評価",
    "payee": "5-1_RS_{year}_支出先_支出情報",
    "connection": "5-2_RS_{year}_支出先_支出ブロックのつながり",
    "breakdown": "5-3_RS_{year}_支出先_費目・使途",
    "contract": "5-4_RS_{year}_支出先_国庫債務負担行為等による契約",
    "remark": "6-1_RS_{year}_その他備考",
}

#: Header rows of the groups that are read, without the byte order mark.
HEADERS: dict[str, tuple[str, ...]] = {
    "organization": (
        "シート種別", "事業年度", "予算事業ID", "事業名", "建制順", "所管府省庁", "府省庁", "局・庁", "部", "課", "室", "班", "係", "その他担当組織_作成責任者_no", "府省庁（その他担当組織）", "局・庁（その他担当組織）",
        "部（その他担当組織）", "課（その他担当組織）", "室（その他担当組織）", "班（その他担当組織）", "係（その他担当組織）", "作成責任者",
    ),
    "summary": (
        "シート種別", "事業年度", "予算事業ID", "事業名", "府省庁の建制順", "政策所管府省庁", "府省庁", "局・庁", "部", "課", "室", "班", "係", "事業の目的", "現状・課題", "事業の概要", "事業概要URL", "事業区分",
        "事業開始年度", "開始年度不明", "事業終了（予定）年度", "終了予定なし", "主要経費", "備考", "実施方法ー直接実施", "実施方法ー補助", "実施方法ー負担", "実施方法ー交付", "実施方法ー分担金・拠出金", "実施方法ーその他", "旧事業番号",
        "整理表表示順",
    ),
    "law": (
        "シート種別", "事業年度", "予算事業ID", "事業名", "府省庁の建制順", "政策所管府省庁", "府省庁", "局・庁", "部", "課", "室", "班", "係", "番号（政策・施策）", "政策所管府省庁_P", "政策", "施策",
        "政策・施策URL", "番号（根拠法令）", "法令名", "法令番号", "法令ID", "条", "項", "号・号の細分", "番号（関係する計画・通知等）", "計画通知名", "計画通知等URL",
    ),
    "budget": (
        "シート種別", "事業年度", "予算事業ID", "事業名", "府省庁の建制順", "政策所管府省庁", "府省庁", "局・庁", "部", "課", "室", "班", "係", "予算年度", "当初予算（合計）", "補正予算（合計）",
        "前年度からの繰越し（合計）", "予備費等（合計）", "計（歳出予算現額合計）", "執行額（合計）", "執行率", "翌年度への繰越し(合計）", "翌年度要求額（合計）", "主な増減理由", "その他特記事項", "会計区分", "会計", "勘定", "当初予算",
        "第1次補正予算", "第2次補正予算", "第3次補正予算", "第4次補正予算", "第5次補正予算", "前年度から繰越し", "予備費等1", "予備費等2", "予備費等3", "予備費等4", "歳出予算現額", "執行額", "翌年度要求額", "要望額", "備考",
    ),
    "payee": (
        "シート種別", "事業年度", "予算事業ID", "事業名", "府省庁の建制順", "政策所管府省庁", "府省庁", "局・庁", "部", "課", "室", "班", "係", "支出先ブロック番号", "支出先ブロック名", "支出先の数", "事業を行う上での役割",
        "ブロックの合計支出額", "支出先名", "法人番号", "所在地", "法人種別", "その他支出先", "支出先の合計支出額", "契約概要", "金額", "契約方式等", "具体的な契約方式等", "入札者数", "落札率",
        "一者応札・一者応募又は競争性のない随意契約となった理由及び改善策（支出額10億円以上）", "その他の契約",
    ),
    "connection": (
        "シート種別", "事業年度", "予算事業ID", "事業名", "府省庁の建制順", "政策所管府省庁", "府省庁", "局・庁", "部", "課", "室", "班", "係", "支出元の支出先ブロック", "支出元の支出先ブロック名", "担当組織からの支出",
        "支出先の支出先ブロック", "支出先の支出先ブロック名", "資金の流れの補足情報", "国自らが支出する間接経費", "国自らが支出する間接経費の項目", "国自らが支出する間接経費の金額",
    ),
}
