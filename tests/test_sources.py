"""Landed-file parsers on small fixture files written into a temp folder."""

import json
import os

from rivulet.sources import landed as L


def _w(d, name, text, enc="utf-8"):
    p = os.path.join(d, name)
    with open(p, "w", encoding=enc) as fh:
        fh.write(text)
    return p


def test_ml1m(spark, tmpdir_path):
    d = tmpdir_path
    mv = _w(d, "movies.dat", "1::Toy Story (1995)::Animation|Children's|Comedy\n2::Jumanji::Adventure\n"
                             "3::bad line\n4::Café Society (2016)::Film-Noir\n", "latin-1")
    rt = _w(d, "ratings.dat", "1::1::5::978300760\n1::2::2::978302109\n2::9::3::978301968\n7::1\n")
    us = _w(d, "users.dat", "1::F::1::10::48067\n2::M::56::16::70072\n3::M\n")
    t = L.ml1m_tables(spark, mv, rt, us)
    items = {r.item_id: r for r in t["items"].collect()}
    assert set(items) == {"ml_movie_1", "ml_movie_2", "ml_movie_4"}
    assert items["ml_movie_1"].title == "Toy Story" and items["ml_movie_1"].category == "Animation"
    assert items["ml_movie_2"].description == "Year: 2000. Genres: Adventure."
    assert items["ml_movie_4"].title == "Café Society" and items["ml_movie_4"].category == "Thriller"
    assert 2.5 <= items["ml_movie_1"].rating <= 5.0
    inter = {r.item_id: r for r in t["interactions"].collect()}
    assert set(inter) == {"ml_movie_1", "ml_movie_2"}  # movie 9 unknown, short line skipped
    assert inter["ml_movie_1"].interaction_type == "like" and inter["ml_movie_2"].interaction_type == "dislike"
    users = {r.user_id: r.age_group for r in t["users"].collect()}
    assert users == {"ml_user_1": "18-24", "ml_user_2": "65+"}
    again = {r.item_id: r.rating for r in L.ml1m_tables(spark, mv, rt, us)["items"].collect()}
    assert again == {k: v.rating for k, v in items.items()}  # seeded fills repeat


def test_bookcrossing(spark, tmpdir_path):
    d = tmpdir_path
    books = _w(d, "b.csv", '"ISBN";"Book-Title";"Book-Author";"Year-Of-Publication";"Publisher";'
                           '"Image-URL-S";"Image-URL-M";"Image-URL-L"\n'
                           '"0001";"Clara Callan";"Richard Wright";"2001";"P";"s";"m1";"l"\n'
                           '"0002";"";"X";"2000";"P";"s";"m2";"l"\n', "latin-1")
    ratings = _w(d, "r.csv", '"User-ID";"ISBN";"Book-Rating"\n"10";"0001";"8"\n"11";"0001";"0"\n'
                             '"12";"0001";"x"\n"13";"9999";"5"\n')
    users = _w(d, "u.csv", '"User-ID";"Location";"Age"\n"10";"a";"20"\n"11";"b";"NULL"\n')
    t = L.bookcrossing_tables(spark, books, ratings, users)
    items = t["items"].collect()
    assert [(r.item_id, r.tags, r.description, r.thumbnail_url) for r in items] == [
        ("bx_0001", ["Richard Wright", "Books"], "By Richard Wright. Published: 2001.", "m1")]
    inter = t["interactions"].collect()
    assert [(r.user_id, r.item_id, r.rating, r.interaction_type) for r in inter] == [
        ("bx_user_10", "bx_0001", 8.0, "like")]
    assert {r.user_id for r in t["users"].collect()} == {"bx_user_10", "bx_user_11"}


def test_steam_forms(spark, tmpdir_path):
    d = tmpdir_path
    recs = [{"id": "1", "name": "Alpha", "genres": ["RPG", "Indie"], "price": "Free to Play",
             "short_description": "Fun"},
            {"id": "2", "app_name": "Beta", "genres": [{"description": "Action"}], "price": "9.99", "desc": "D"},
            {"id": "3", "name": "", "genres": []}]
    arr = _w(d, "a.json", json.dumps(recs))
    lines = _w(d, "l.json", "\n".join(json.dumps(r) for r in recs))
    obj = _w(d, "o.json", json.dumps({r["id"]: r for r in recs}))
    for p in (arr, lines, obj):
        got = {r.item_id: r for r in L.steam_items(spark, p).collect()}
        assert set(got) == {"steam_1", "steam_2"}
        assert got["steam_1"].description == "Fun (Free to Play)" and got["steam_1"].category == "RPG"
        assert got["steam_2"].title == "Beta" and got["steam_2"].tags == ["Action"]
        assert got["steam_2"].description == "D"


def test_amazon(spark, tmpdir_path):
    recs = [{"asin": "A1", "title": "Phone X", "category": ["Electronics", "Phones"], "overall": "4",
             "reviewerID": "r1"},
            {"asin": "A1", "title": "dup", "overall": "5", "reviewerID": "r2"},
            {"asin": "A2", "summary": "Widget", "category": "Gadgets", "overall": "7", "reviewText": "x" * 500},
            {"asin": "", "title": "none"}]
    p = _w(tmpdir_path, "amz.json", "\n".join(json.dumps(r) for r in recs))
    t = L.amazon_tables(spark, p)
    items = {r.item_id: r for r in t["items"].collect()}
    assert items["amz_A1"].title == "Phone X" and items["amz_A1"].category == "Phones"
    assert items["amz_A2"].category == "Electronics" and items["amz_A2"].rating == 5.0
    assert len(items["amz_A2"].description) == 500
    cut = {r.item_id: r for r in L.amazon_tables(spark, p, max_text=400)["items"].collect()}
    assert len(cut["amz_A2"].description) == 400
    assert sorted(r.user_id for r in t["interactions"].collect()) == ["amz_user_r1", "amz_user_r2"]


def test_api_payloads(spark, tmpdir_path):
    d = tmpdir_path
    tm = _w(d, "tmdb.json", json.dumps({"results": [
        {"id": 155, "title": "The Dark Knight", "genre_ids": [28, 1], "overview": "o", "poster_path": "/p.jpg",
         "vote_average": 8.5, "vote_count": 30000}]}))
    r = L.tmdb_movie_items(spark, tm).first()
    assert (r.item_id, r.category, r.tags, r.rating, r.view_count, r.thumbnail_url) == (
        "tmdb_movie_155", "Action", ["Action", "Drama"], 4.3, 30000, L.TMDB_IMAGE_BASE + "/p.jpg")
    tv = _w(d, "tv.json", json.dumps({"results": [{"id": 7, "name": "Show", "genre_ids": [], "vote_average": 7}]}))
    r = L.tmdb_tv_items(spark, tv).first()
    assert (r.item_id, r.content_type, r.category, r.thumbnail_url) == ("tmdb_tv_7", "video", "Drama", "")
    rw = _w(d, "rawg.json", json.dumps({"results": [{"id": 3, "name": "G", "genres": [{"name": "RPG"}],
                                                     "tags": [{"name": f"t{i}"} for i in range(7)],
                                                     "platforms": [{"platform": {"name": n}} for n in "ABCD"],
                                                     "released": "2020-01-01", "rating": 4.46,
                                                     "ratings_count": 9}]}))
    r = L.rawg_items(spark, rw).first()
    assert r.tags == ["RPG", "t0", "t1", "t2", "t3", "t4"] and r.rating == 4.5
    assert r.description == "Released: 2020-01-01. Metacritic: N/A. Platforms: A, B, C"
    ol = _w(d, "ol.json", "\n".join(json.dumps(x) for x in [
        {"subject": "science", "subject_order": 0, "works": [
            {"key": "/works/W1", "title": "T1", "cover_id": 12, "authors": [{"name": "a"}, {"name": "b"},
                                                                              {"name": "c"}]}]},
        {"subject": "art", "subject_order": 1, "works": [{"key": "/works/W1", "title": "T1"},
                                                         {"key": "/works/W2", "title": "T2"}]}]))
    got = {r.item_id: r for r in L.openlibrary_items(spark, ol).collect()}
    assert set(got) == {"ol_W1", "ol_W2"} and got["ol_W1"].category == "Science"
    assert got["ol_W1"].tags == ["science", "a", "b"] and got["ol_W2"].description == "By Unknown Author. Subject: Art."
    assert got["ol_W1"].thumbnail_url == "https://covers.openlibrary.org/b/id/12-M.jpg"
    nd = _w(d, "nd.json", json.dumps({"category": "science", "results": [
        {"title": "A", "content": "c"}, {"title": ""}, {"title": "B", "description": "d", "source_name": "S"}]}))
    got = sorted((r.title, r.description, r.tags[1]) for r in L.newsdata_items(spark, nd).collect())
    assert got == [("A", "c", "News"), ("B", "d", "S")]
    na = _w(d, "na.json", json.dumps({"category": "health", "articles": [
        {"title": "[Removed]"}, {"title": "X" * 300, "description": "y" * 600, "source": {"name": "Src"}}]}))
    whole = L.newsapi_items(spark, na).collect()
    assert len(whole[0].title) == 300 and len(whole[0].description) == 600
    r = L.newsapi_items(spark, na, max_title=200, max_text=500).collect()
    assert len(r) == 1 and len(r[0].title) == 200 and len(r[0].description) == 500 and r[0].tags == ["health", "Src"]
    lf = _w(d, "lf.json", json.dumps({"page": 1, "tracks": {"track": [
        {"name": f"s{i}", "listeners": "10", "artist": {"name": "Ar"}, "image": [{"#text": "a"}, {"#text": "b"}]}
        for i in range(6)]}}))
    r = sorted(L.lastfm_items(spark, lf).collect(), key=lambda x: x.title)
    assert [x.content_type for x in r] == ["podcast", "music", "music", "music", "music", "podcast"]
    assert r[0].title == "s0 — Ar" and r[0].thumbnail_url == "b" and r[0].view_count == 10
    sp = _w(d, "sp.json", json.dumps({"market": "US", "albums": {"items": [
        {"id": "x1", "name": "Al", "artists": [{"name": "Ar"}], "album_type": "single", "total_tracks": 2}]}}))
    r = L.spotify_items(spark, sp).first()
    assert r.title == "Al — Ar" and r.tags[2] == "Single" and r.description.endswith("Tracks: 2")
    yt = _w(d, "yt.json", json.dumps({"items": [
        {"id": "v1", "snippet": {"title": "V", "categoryId": "10", "tags": [str(i) for i in range(12)],
                                 "thumbnails": {"medium": {"url": "m"}, "default": {"url": "d"}}},
         "statistics": {"viewCount": "77"}},
        {"id": "v2", "snippet": {"title": "W", "categoryId": "999"}}]}))
    got = {r.item_id: r for r in L.youtube_items(spark, yt).collect()}
    assert got["yt_v1"].category == "Music" and got["yt_v1"].thumbnail_url == "m" and len(got["yt_v1"].tags) == 10
    assert got["yt_v2"].category == "Entertainment" and got["yt_v2"].tags == ["Entertainment"]
    ff = _w(d, "ff.json", json.dumps({"category": "frozen-foods", "products": [
        {"id": "p1", "product_name": "Peas", "brands": "Acme, Other", "nutriscore_grade": "a"},
        {"id": "p2", "product_name": " "}]}))
    r = L.foodfacts_items(spark, ff).collect()
    assert len(r) == 1 and r[0].title == "Peas — Acme" and r[0].category == "Frozen Foods"
    assert r[0].description == "Brand: Acme. Category: frozen-foods. Nutriscore: A"


def test_ml25m(spark, tmpdir_path):
    d = tmpdir_path
    mv = _w(d, "movies.csv", 'movieId,title,genres\n1,"American President, The (1995)",Comedy|Drama\n2,X,Sci-Fi\n')
    rt = _w(d, "ratings.csv", "userId,movieId,rating,timestamp\n5,1,4.5,100\n6,3,1.0,200\n5,2,2.0,300\n")
    lk = _w(d, "links.csv", "movieId,imdbId,tmdbId\n1,113,9087\n2,1,\n")
    t = L.ml25m_tables(spark, mv, rt, lk)
    assert {r.title for r in t["items"].collect()} == {"American President, The", "X"}
    assert sorted(r.item_id for r in t["interactions"].collect()) == ["ml25_movie_1", "ml25_movie_2"]
    assert [r.user_id for r in t["users"].collect()] == ["ml25_user_5"]
    assert [(r.source_id, r.tmdb_id) for r in t["links"].collect()] == [("1", "9087")]
