from packloom.sources.rust import list_tests, public_api, strip_bodies

SOURCE = '''//! doc }
#![allow(x)]
pub fn a<T: X>(s: &str) -> Vec<T> where T: Y { let c = '}'; let r = r#"}"#; loop {} }
fn b() {}
const N: [u8; 2] = [1, 2];
impl Z { pub fn inner() {} }
macro_rules! m { () => {} }
#[cfg(test)] mod t { #[test] fn one() {} #[tokio::test] async fn two() {} #[test_case] fn no() {} fn helper() {} }
#[test]
fn top() {}
'''


def test_outlines():
    assert public_api(SOURCE).split("\n") == ["pub fn a<T: X>(s: &str) -> Vec<T> where T: Y { /* ... */ }", "macro_rules! m { () => {} }"]
    assert list_tests(SOURCE) == ["fn one()", "async fn two()", "fn top()"]
    out = strip_bodies(SOURCE)
    assert "fn b() { /* ... */ }" in out and "const N: [u8; 2] = [1, 2];" in out and "loop" not in out


def test_broken_sources_end():
    for s in ("", "}", "fn", "fn x( {", '"', "#[", "pub", "{{{"):
        strip_bodies(s), public_api(s), list_tests(s)
